"""Reading and writing shared storage from Python tasks."""

from __future__ import annotations

from pyarrow import fs


def shared_file(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[len("s3a://"):]
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)
