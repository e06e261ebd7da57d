"""Text columns: hashing, normalising, counting, small maps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

# Results must equal these.
FENCE = "```"
ESCAPED_FENCE = "` ``"
TRUE_WORDS = ("yes", "y")
FALSE_WORDS = ("no", "n")
PREVIEW_CHARS = 200
SECRET_SET = "[HIDDEN]"
SECRET_UNSET = "NOT SET"

DEFAULT_TAG = "# Docstrings added automatically"
WORD, BLANKS = "[A-Za-z0-9_]", " \t\r\n"
_OUTER_BLANKS = r"^[ \t\r\n\f]+|[ \t\r\n\f]+\z"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _OUTER_BLANKS, "")


def universal_newlines(text: Column) -> Column:
    """Text as read in text mode; hashes are taken of the raw content."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_hash(content: Column) -> Column:
    """SHA-256 hex; unreadable content hashes to the empty string."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def ensure_header(content: Column, tag: str = DEFAULT_TAG) -> Column:
    return F.when(F.contains(content, F.lit(tag)), content).otherwise(
        F.concat(F.lit(tag + "\n"), content)
    )


def ensure_trailing_newline(content: Column) -> Column:
    return F.when(content.endswith("\n"), content).otherwise(F.concat(content, F.lit("\n")))


def escape_fences(content: Column) -> Column:
    return F.replace(content, F.lit(FENCE), F.lit(ESCAPED_FENCE))


def unescape_fences(content: Column) -> Column:
    return F.replace(content, F.lit(ESCAPED_FENCE), F.lit(FENCE))


def sanitize_name(name: Column) -> Column:
    return F.regexp_replace(F.replace(name, F.lit("/"), F.lit("-")), "[^A-Za-z0-9_-]+", "_")


def stable_suffix(key: Column) -> Column:
    """Eight hex characters that stay the same on a re-run."""
    return F.substring(F.sha2(key, 256), 1, 8)


def repository_owner_and_name(url: Column, host: str = "github.com") -> Column:
    """``struct<owner, name>`` from an https or ssh remote; nulls if no match."""
    # What follows the host and one separator; the owner ends at the first slash.
    rest = F.substr(url, F.locate(host, url) + F.lit(len(host) + 1))
    slash = F.locate("/", rest, 2)
    name = F.substr(rest, slash + F.lit(1))
    bare = F.when(name.endswith(".git") & (F.length(name) > 4), F.left(name, F.length(name) - 4)).otherwise(name)
    separator = F.substr(url, F.locate(host, url) + F.lit(len(host)), F.lit(1))
    found = url.contains(host) & separator.isin(":", "/") & (slash > 1) & (name != "")
    return F.struct(
        F.when(found, F.left(rest, slash - 1)).alias("owner"),
        F.when(found, bare).alias("name"),
    )


def token_count(text: Column, pattern: str | None = None) -> Column:
    """Words, and every other character that is not blank; or a pattern's matches.

    The default shortens words to one letter, takes the blanks out and measures
    what is left: ``regexp_count`` would build an array of all tokens first.
    """
    if pattern is not None:
        return F.regexp_count(text, F.lit(pattern)).cast("bigint")
    rest = F.regexp_replace(text, WORD + "+", "w")
    for blank in BLANKS:
        rest = F.replace(rest, F.lit(blank), F.lit(""))
    return F.length(rest).cast("bigint")


def token_counter(make_count: Callable) -> Callable[[Column], Column]:
    """Counts as a model's vocabulary has them, as a column function.

    ``make_count`` runs once per Python worker and returns ``count(text) -> int``.
    Each distinct text of an Arrow batch is counted once, nothing is shuffled; a
    null text has a null count.
    """
    held: list = []

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(make_count())
        codes, distinct = texts.factorize()
        counts = pd.Series([held[0](t) for t in distinct], dtype="Int64")
        return counts.reindex(codes).reset_index(drop=True)  # code -1 is a null text

    return counted


def decision(answer: Column) -> Column:
    word = F.lower(strip(answer))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(
        word.isin(*FALSE_WORDS), F.lit(False)
    )


def first_line(doc: Column) -> Column:
    return F.substring_index(strip(doc), "\n", 1)


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.left(text, F.lit(chars))


def secret_state(secret: Column) -> Column:
    return F.when(secret.isNull() | (secret == ""), F.lit(SECRET_UNSET)).otherwise(
        F.lit(SECRET_SET)
    )


def nonblank_lines(text: Column) -> Column:
    return F.filter(F.split(strip(text), "\n"), lambda line: line != "")
