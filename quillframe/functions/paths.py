"""Relative path columns. The root folder is the empty string."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda part: (part != "") & (part != "."))


def normalize(path: Column) -> Column:
    """Without ``//``, ``./`` and a trailing slash."""
    joined = F.array_join(components(path), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return normalize(
        F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
    )


def depth(path: Column) -> Column:
    return F.size(components(path))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*\z", "")


def suffix(path: Column) -> Column:
    """Last extension with its dot; a leading-dot name has none."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)\z", 1)


def with_suffix(path: Column, new_suffix: str) -> Column:
    stem = F.left(path, F.length(path) - F.length(suffix(path)))
    return F.concat(stem, F.lit(new_suffix))


def size_bytes(content: Column) -> Column:
    return F.octet_length(content).cast("bigint")


def folder_of(path: Column, max_depth: int) -> Column:
    """Deepest containing folder no deeper than ``max_depth``."""
    parts = components(path)
    levels = F.least(F.lit(max_depth), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_join(F.slice(parts, F.lit(1), levels), "/")


def folders_down_to(folder: Column) -> Column:
    """The root, every folder on the way, and the folder itself."""
    parts = components(folder)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def is_hidden(path: Column) -> Column:
    """True under a folder whose name starts with a dot; hidden files are not."""
    return path.rlike(r"(^|/)\.[^/]+/")


def url_path(url: Column) -> Column:
    """Host and path of a web address, as a relative path."""
    bare = F.regexp_replace(url, r"^[a-z]+://|[?#].*\z", "")
    return normalize(bare)
