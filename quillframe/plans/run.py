"""One whole run over a file table, resumable through its state folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quillframe import schemas
from quillframe.functions.text import DEFAULT_TAG
from quillframe.operators import changes, folders, reports
from quillframe.plans import describe, document, incremental
from quillframe.scratch import written
from quillframe.sources import storage


@dataclass(frozen=True)
class RunSettings:
    state_root: str
    collection: str
    package: str
    at: Column
    report_depth: int = 2  # fixed value: default folder depth of reports
    report_per_file: bool = False
    tag: str = DEFAULT_TAG
    out_dir: str = "data"
    retrieve_type: str = describe.DESCRIPTION_TYPE
    tree: str | None = None
    embedding_model: str = "hashed-words"  # each model keeps embeddings of its own
    retry: tuple = ()


@dataclass(frozen=True)
class RunTables:
    """What a run leaves behind; every table is written or derived from written ones."""

    pending: DataFrame
    descriptions: DataFrame
    verdict: DataFrame
    contents: DataFrame
    manifest: DataFrame
    reports: DataFrame
    files: DataFrame


def run(
    files: DataFrame,
    settings: RunSettings,
    make_describe: Callable,
    make_document: Callable,
    make_predict: Callable | None = None,
    decisions: DataFrame | None = None,
    folder_decisions: DataFrame | None = None,
) -> RunTables:
    """Detect, describe, store, retrieve, document, approve, version, report.

    ``decisions`` (path, answer) gate files, ``folder_decisions`` (folder,
    answer) the changes of a report's folder; without a table all pass.
    ``files`` has (path, content) and is read more than once: pass a table.
    """
    spark, root, retry = files.sparkSession, settings.state_root, dict(settings.retry)
    # a run counts once its manifest is there; until then it has the same number
    number = 1 + max(storage.versions(spark, f"{root}/manifest"), default=0)
    storage.get_or_create_collection(spark, settings.collection, f"{root}/vectors")
    summaries = storage.load_version(spark, f"{root}/summaries", schemas.SUMMARIES)

    # descriptions have the number of the summaries they become part of: a repeat adds to what is kept there
    described_as = 1 + max(storage.versions(spark, f"{root}/summaries"), default=0)

    embeddings = f"{root}/embeddings/{settings.embedding_model}"
    pending = incremental.pending_files(files, root)
    fresh = describe.describe_pending(pending, files, summaries, make_describe, f"{root}/replies/describe", settings.tree, **retry)
    storage.save_descriptions(fresh, f"{root}/descriptions", settings.out_dir, described_as)
    rows = describe.vector_rows(fresh, settings.out_dir, {"file_type": describe.DESCRIPTION_TYPE})
    verdict = describe.store_vectors(rows, settings.collection, "descriptions", make_predict, embeddings)
    known = describe.keep_summaries(summaries, fresh, root)

    todo = written(changes.attach_content(pending.select("path"), files), "todo")
    stored = spark.table(settings.collection).where(F.col("file_type") == settings.retrieve_type)
    lookup = describe.first_descriptions(todo, known.withColumn("ordinal", F.lit(0)))
    asked = written(document.document_prompts(todo, stored, lookup, settings.package, make_predict, embeddings), "prompts")
    outputs = document.new_contents(asked, make_document, settings.tag, f"{root}/replies/document", **retry)
    changeset = written(folders.assign_by_depth(
        document.approved_contents(outputs, decisions), settings.report_depth, settings.report_per_file), "changeset")
    if folder_decisions is not None:
        changeset = reports.approved_only(changeset, folder_decisions, "folder")
    contents = changeset.drop("folder")

    document.keep_versions(todo, contents, settings.at, root, number)
    manifest = incremental.record_hashes(
        contents.select("path", F.col("new_content").alias("content")), root
    )
    return RunTables(
        pending=pending,
        descriptions=fresh,
        verdict=verdict,
        contents=contents,
        manifest=manifest,
        reports=reports.change_reports(changeset),
        files=document.updated_files(files, contents),
    )

