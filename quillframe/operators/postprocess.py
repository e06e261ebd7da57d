"""Post-processors of model output, chosen by name with JSON arguments."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from quillframe import schemas
from quillframe.functions import text
from quillframe.operators.changes import accepted

_by_name: dict[str, Callable[..., DataFrame]] = {}


def post_processor(name: str):
    def register(function: Callable[..., DataFrame]):
        _by_name[name] = function
        return function

    return register


def apply_named(df: DataFrame, name: str, arguments: str = "{}") -> DataFrame:
    if name not in _by_name:
        raise ValueError(f"no post-processor named {name!r}")
    return df.transform(_by_name[name], **json.loads(arguments))


def tool_content(arguments) -> F.Column:
    """The one required field of the tool-call arguments."""
    return F.from_json(arguments, schemas.TOOL_ARGUMENTS)["new_file_content"]


@post_processor("write_new_content")
def write_new_content(outputs: DataFrame, tag: str = text.DEFAULT_TAG) -> DataFrame:
    """(…, args) -> (…, new_content): parse, undo the fence escape, drop empty
    outputs, then make sure of header and final newline."""
    content = F.col("new_content")
    parsed = outputs.withColumn("new_content", text.unescape_fences(tool_content(F.col("args"))))
    headed = accepted(parsed.drop("args")).withColumn("new_content", text.ensure_header(content, tag))
    return headed.withColumn("new_content", text.ensure_trailing_newline(content))
