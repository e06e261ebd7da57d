"""Describe files with a model, keep the summaries, store them as vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from quillframe import schemas
from quillframe.functions import paths, prompts
from quillframe.functions.text import token_count
from quillframe.operators import changes, completion, embedding, vectors
from quillframe.operators.ordering import first_per_key
from quillframe.scratch import written
from quillframe.sources import storage

DESCRIPTION_TYPE = "description"  # fixed value: tag of stored descriptions


def describe_pending(
    pending: DataFrame,
    files: DataFrame,
    summaries: DataFrame,
    make_complete: Callable,
    replies_root: str,
    tree: str | None = None,
    **retry,
) -> DataFrame:
    """(path, description) of pending files that have no summary yet.

    ``tree`` is a project tree for every prompt, if it is small enough for that.

    Replies are kept in ``replies_root``, so a later run never pays for them
    again. A failed call leaves its file without a description for the next run.
    """
    todo = changes.attach_content(vectors.not_described(pending.select("path"), summaries), files)
    asked = written(todo.select(
        "path", prompts.describe_prompt(F.col("content"), F.col("path"), F.lit(tree)).alias("prompt")
    ), "prompts")
    replies = completion.complete_durably(asked, make_complete, replies_root, **retry)
    texts = completion.completed_texts(asked, replies)
    return written(texts.select("path", F.col("text").alias("description")), "described")


def keep_summaries(old: DataFrame, fresh: DataFrame, state_root: str) -> DataFrame:
    root = f"{state_root}/summaries"
    storage.save_version(old.select("path", "description").unionByName(fresh), root)
    return storage.load_version(old.sparkSession, root, schemas.SUMMARIES)


def vector_rows(fresh: DataFrame, out_dir: str, tags: dict[str, str]) -> DataFrame:
    """(id, document, metadata): one per description, tags over the file path."""
    placed = storage.described(fresh, out_dir)
    own = F.create_map(F.lit("file_path"), F.col("out_path"))
    extra = F.create_map(*[F.lit(part) for pair in tags.items() for part in pair])
    return placed.select(
        F.col("out_path").alias("id"),
        F.col("description").alias("document"),
        vectors.merge_metadata(own, extra).alias("metadata"),
    )


def class_vector_rows(summaries: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """(id, document, metadata) of class summaries (path, class_name, summary).

    The id joins path and class. A class without a summary has no row; of a class
    that occurs again in a file the first summary by text counts.
    """
    pairs = [F.lit("file_path"), F.col("path"), F.lit("class_name"), F.col("class_name")]
    pairs += [F.lit(part) for pair in (tags or {}).items() for part in pair]
    return (
        summaries.where(F.col("summary") != "").groupBy("path", "class_name").agg(F.min("summary").alias("document"))
        .select(prompts.composite_id(F.col("path"), F.col("class_name")).alias("id"), "document",
                F.create_map(*pairs).alias("metadata"))
    )


def store_vectors(rows: DataFrame, collection: str, batch: str, make_predict: Callable | None = None,
                  embeddings: str | None = None) -> DataFrame:
    """Embed and add a batch if it passes validation; returns the verdict.

    A rejected batch is left out as a whole. Ids already stored stay as they are.
    ``embeddings`` is the folder of a store of embeddings.
    """
    verdict = vectors.batch_verdicts(rows.withColumn("batch", F.lit(batch))).first()
    if verdict is not None and verdict.accepted:
        stored = rows.sparkSession.table(collection)
        fresh = embedding.stored_or_new(vectors.absent_only(rows, stored), embeddings, "document", make_predict)
        ready = fresh.withColumn("file_type", F.col("metadata")["file_type"]).withColumn(
            "tokens", token_count(F.col("document"))
        )
        storage.append_to_collection(ready, collection)
    return rows.sparkSession.createDataFrame(
        [] if verdict is None else [tuple(verdict)],
        "batch string, rows bigint, accepted boolean, reason string",
    )


def first_descriptions(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """(path, description) for every file: the first one listed, or empty.

    ``summaries`` has an ``ordinal`` that says which comes first.
    """
    known = first_per_key(
        summaries.withColumn("path", paths.normalize(F.col("path"))), ["path"], "ordinal"
    )
    return files.select("path").join(known.select("path", "description"), "path", "left").select(
        "path", F.coalesce("description", F.lit("")).alias("description")
    )
