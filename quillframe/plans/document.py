"""Document files: context, prompt, model, post-processing, versions, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quillframe.functions import prompts
from quillframe.operators import code, completion, postprocess, reports
from quillframe.plans.retrieval import import_contexts
from quillframe.scratch import written
from quillframe.sources import storage


def document_prompts(
    files: DataFrame,
    vectors: DataFrame,
    descriptions: DataFrame,
    package: str,
    make_predict: Callable | None = None,
    embeddings: str | None = None,
) -> DataFrame:
    """(path, prompt): retrieved context and description, then the escaped code."""
    parsed = written(code.parse_modules(files), "parsed")
    contexts = import_contexts(parsed, files, vectors, package, make_predict, embeddings=embeddings)
    described = files.select("path", "content").join(descriptions, "path", "left")
    joined = described.join(contexts.select("path", "context"), "path", "left")
    section = prompts.context_section(F.col("context"), F.col("description"))
    return joined.select("path", prompts.document_prompt(F.col("content"), section).alias("prompt"))


def new_contents(
    asked: DataFrame, make_complete: Callable, tag: str, replies_root: str,
    processor: str = "write_new_content", **retry,
) -> DataFrame:
    """(path, new_content) of the accepted model outputs, whose replies ``replies_root`` keeps."""
    replies = completion.complete_durably(asked, make_complete, replies_root, **retry)
    outputs = completion.completed_texts(asked, replies).withColumnRenamed("text", "args")
    return postprocess.apply_named(outputs, processor, json.dumps({"tag": tag}))


def approved_contents(contents: DataFrame, decisions: DataFrame | None) -> DataFrame:
    return contents if decisions is None else reports.approved_only(contents, decisions, "path")


def keep_versions(files: DataFrame, contents: DataFrame, at: Column, state_root: str, run: int = 1) -> None:
    """Append what is about to be replaced to the history, then save the new contents."""
    prior = files.select("path", "content").join(contents.select("path"), "path", "left_semi")
    storage.keep_history(prior, at, f"{state_root}/history", run)
    storage.save_version(
        contents.select("path", F.col("new_content").alias("content")), f"{state_root}/contents"
    )


def updated_files(files: DataFrame, contents: DataFrame) -> DataFrame:
    """The file table after the run. Contents meet by a sort: those of a small file can be too large to broadcast."""
    new = contents.select("path", "new_content").hint("shuffle_merge")
    rest = [c for c in files.columns if c != "content"]
    return files.join(new, "path", "left").select(
        *rest, F.coalesce("new_content", "content").alias("content")
    )
