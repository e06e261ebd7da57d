"""A source tree as a table.

Spark's own file sources leave out names that start with ``_`` or ``.``, so
folders are listed by Python tasks. The folders still to be listed are a table,
the frontier: in each round it is dealt out evenly, every task goes down from
its folders until it has opened its share, and hands on what it found below. So
a deep chain takes few rounds, a wide level is spread over all tasks, and no
names pass through the driver. Names only are listed; path filters run on the
listing, and contents are opened afterwards, spread evenly over the tasks
however uneven the folders are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillframe import schemas
from quillframe.scratch import scratch_path

LISTED = pa.schema([("path", pa.string()), ("size_bytes", pa.int64())])
#: A folder has no size; ``opened`` tells those that have been listed.
ENTRIES = pa.schema([*LISTED, ("is_folder", pa.bool_()), ("opened", pa.bool_())])
OPENED = pa.schema(
    [
        ("path", pa.string()),
        ("size_bytes", pa.int64()),
        ("content", pa.string()),
        ("error", pa.string()),
    ]
)
ROWS_PER_BATCH = 20_000
BYTES_PER_BATCH = 32 * 1024 * 1024
BYTES_PER_TASK = 256 * 1024 * 1024
#: Folders that a task opens in the first round, and in any round at most.
FIRST_SHARE, MOST_SHARE = 8, 1024


def _open_root(root: str) -> tuple[pafs.FileSystem, str]:
    if root.startswith("file:/") and not root.startswith("file://"):
        root = root[len("file:"):]
    if "://" in root:
        filesystem, base = pafs.FileSystem.from_uri(root)
    else:
        filesystem, base = pafs.LocalFileSystem(), root
    return filesystem, base.rstrip("/")


def _entries(filesystem, base: str, folder: str) -> Iterator[tuple[str, int | None]]:
    """Entries of one folder, relative to the base; folders have no size."""
    where = f"{base}/{folder}" if folder else base
    for info in filesystem.get_file_info(pafs.FileSelector(where, allow_not_found=True)):
        path = f"{folder}/{info.base_name}" if folder else info.base_name
        if info.type == pafs.FileType.Directory:
            yield path, None
        elif info.type == pafs.FileType.File:
            yield path, info.size


def open_folders(folders: Iterator[str], entries: Callable[[str], Iterator[tuple[str, int | None]]], share: int,
                 hidden: bool) -> Iterator[tuple[str, int | None, bool, bool]]:
    """(path, size, is_folder, opened) of what is found when at most ``share`` folders are opened.

    The next folder is always the last one found, so a task goes down one branch
    at a time and holds the siblings on its way only. Folders that aren't opened
    are handed on.
    """
    count = 0
    for given in folders:
        pending = [given]
        while pending and count < share:
            folder = pending.pop()
            count += 1
            yield folder, None, True, True
            for path, size in entries(folder):
                if size is not None:
                    yield path, size, False, True
                elif hidden or not path.rsplit("/", 1)[-1].startswith("."):
                    pending.append(path)
        for folder in pending:
            yield folder, None, True, False


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_PER_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def list_entries(spark: SparkSession, root: str, hidden: bool = False, tasks: int | None = None,
                 first_share: int = FIRST_SHARE, most_share: int = MOST_SHARE) -> DataFrame:
    """(path, size_bytes, is_folder) of everything below the root.

    The root itself isn't listed. Folders with a leading dot are left out with
    all below them unless ``hidden``; such files are kept. A missing root has no
    entries. Every round is written, and its frontier is read back as the next
    round's input, so a lost task lists its own folders again and nothing else.
    """
    where = scratch_path(spark, "listing")
    tasks = tasks or max(2 * spark.sparkContext.defaultParallelism, 1)

    def lister(share: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filesystem, base = _open_root(root)
            given = (path for batch in batches for path in batch.column(0).to_pylist())
            yield from _batched(open_folders(given, lambda f: _entries(filesystem, base, f), share, hidden), ENTRIES)

        return run

    frontier, share, number = spark.createDataFrame([("",)], "path string"), first_share, 0
    while True:
        path = f"{where}/round={number}"
        frontier.repartition(tasks).mapInArrow(lister(share), schemas.ENTRIES).write.parquet(path)
        frontier = spark.read.schema(schemas.ENTRIES).parquet(path).where("NOT opened").select("path")
        if frontier.isEmpty():
            break
        share, number = min(4 * share, most_share), number + 1
    return spark.read.schema(schemas.ENTRIES).parquet(*[f"{where}/round={n}" for n in range(number + 1)]).where(
        "opened AND path <> ''").drop("opened")


def list_tree(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """(path, size_bytes) of all files outside hidden folders."""
    return list_entries(spark, root, tasks=tasks).where("NOT is_folder").select("path", "size_bytes")


def _opener(root: str):
    def open_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open_root(root)
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                content = error = None
                try:
                    with filesystem.open_input_file(f"{base}/{row['path']}") as handle:
                        content = handle.readall().decode("utf-8")
                except Exception as problem:  # one unreadable file must not end the scan
                    error = f"{type(problem).__name__}: {problem}"
                rows.append({**row, "content": content, "error": error})
                held += row["size_bytes"]
                if held >= BYTES_PER_BATCH or len(rows) >= ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=OPENED)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=OPENED)

    return open_files


def open_tree(listing: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """Attach contents to a filtered listing; an unreadable file keeps its row.

    The number of tasks follows the bytes to read, not the bytes of the listing,
    which AQE would squeeze into a few tasks. The listing is read for their sum
    first; ``list_tree`` gives a stored one.
    """
    if tasks is None:
        total = listing.agg(F.sum("size_bytes")).first()[0] or 0
        cores = listing.sparkSession.sparkContext.defaultParallelism
        tasks = max(cores, math.ceil(total / BYTES_PER_TASK))
    return listing.repartition(tasks, "path").mapInArrow(_opener(root), schemas.FILES)


def scan_tree(spark: SparkSession, root: str, file_suffix: str = ".py", tasks: int | None = None) -> DataFrame:
    """Files with the suffix, outside hidden folders, with their contents."""
    listing = list_tree(spark, root).where(F.col("path").endswith(file_suffix))
    return open_tree(listing, root, tasks)


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write (path, content) rows as files from the tasks; returns what was written."""

    def write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open_root(root)
        made: set[str] = set()
        for batch in batches:
            names, sizes = [], []
            for row in batch.to_pylist():
                target = f"{base}/{row['path']}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                data = row["content"].encode("utf-8")
                with filesystem.open_output_stream(target) as handle:
                    handle.write(data)
                names.append(row["path"])
                sizes.append(len(data))
            if names:
                yield from _batched(zip(names, sizes), LISTED)

    return files.select("path", "content").mapInArrow(write_files, schemas.LISTING)

