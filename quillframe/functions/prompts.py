"""Prompts as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillframe.functions.text import escape_fences

# Prompt texts and limits that must be matched to the letter.
REQUEST_TOKEN_LIMIT = 64000
DESCRIBE_PREAMBLE = (
    "Provide a comprehensive & detailed description of the following Python file. "
    "Highlight its main functionalities, purpose, classes, and function constructors. "
    "Include any important details that would help understand the purpose, functionality, context, structure, and intent of the code. "
    "Most importantly, highlight how it integrates with other parts of the code and project.\n\n"
)
DESCRIBE_TREE = "This is the project structure : "
DESCRIBE_PATH = "The Python file to describe is: "
DESCRIBE_CONTENT = "File content :```python\n"
DOCUMENT_PREAMBLE = (
    "You will be asked to generate dosctrings for a Python . "
    "To do so we will give you some contextual information in the section (Context), then the script in the section (Instructions) .\n"
)
DOCUMENT_CONTEXT = "\n\n## Context\n\n"
DOCUMENT_INSTRUCTIONS = (
    "\n\n## Instructions\n\n"
    "Please add appropriate docstrings to the following Python code. "
    "Ensure that all functions, classes, and modules have clear and concise docstrings explaining their purpose, parameters, return values, and any exceptions raised.\n\n"
    "### Original python script :```python\n"
)
CLOSING_FENCE = "\n```"
NO_CONTEXT = "We haven't been able to provide additional context"
EXAMPLES_TITLE = "Python classes with comprehensive docstrings:\n\n"
MORE_TITLE = "More informations\n"


def _block(before: str, value: Column, after: str) -> Column:
    """``before + value + after``, or nothing when the value is null or empty."""
    return F.when(
        F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), value, F.lit(after))
    ).otherwise(F.lit(""))


def describe_prompt(content: Column, path: Column | None = None, tree: Column | None = None) -> Column:
    nothing = F.lit("")
    return F.concat(
        F.lit(DESCRIBE_PREAMBLE),
        nothing if tree is None else _block(DESCRIBE_TREE, tree, "\n\n"),
        nothing if path is None else _block(DESCRIBE_PATH + "`", path, "`\n\n"),
        F.lit(DESCRIBE_CONTENT),
        content,
        F.lit(CLOSING_FENCE),
    )


def context_section(retrieved: Column, description: Column) -> Column:
    return F.concat(
        _block(EXAMPLES_TITLE, retrieved, "\n\n"), _block(MORE_TITLE, description, "\n\n")
    )


def document_prompt(code: Column, context: Column) -> Column:
    return F.concat(
        F.lit(DOCUMENT_PREAMBLE + DOCUMENT_CONTEXT),
        F.coalesce(F.nullif(context, F.lit("")), F.lit(NO_CONTEXT)),
        F.lit(DOCUMENT_INSTRUCTIONS),
        escape_fences(code),
        F.lit(CLOSING_FENCE),
    )


def context_budget(code: Column, limit: int = REQUEST_TOKEN_LIMIT) -> Column:
    """Half of what the code leaves; characters count as tokens, as specified."""
    return F.floor((F.lit(limit) - F.length(code)) / 2).cast("bigint")


def composite_id(path: Column, name: Column) -> Column:
    return F.concat_ws("::", path, name)
