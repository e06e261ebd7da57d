"""The hash manifest as the state of a stream, keyed by path.

A micro-batch looks up and replaces the hashes of its own paths in the state
store, so what it costs grows with what has arrived and not with the manifest.
State and output of a batch are committed together: one that is replayed after a
failure finds the state as it was and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quillframe import schemas
from quillframe.operators import changes
from quillframe.streaming.arrivals import ARRIVALS

CHANGED = "path string, sha256 string, size_bytes bigint, known string"
STATE = "manifest"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Newest(StatefulProcessor):
    """One path at a time: its newest hash is kept, a row comes out if that is another than before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hash = handle.getValueState(STATE, "sha256 string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept, told, arrived = self.hash.get(), [], []
        for r in rows:
            (told if r.recorded else arrived).append((r.sha256,) if r.recorded else (r.arrived, r.sha256, r.size_bytes))
        before = max(told)[0] if told else kept[0] if kept else None
        after = max(arrived)[1] if arrived else before
        if kept is None or kept[0] != after:
            self.hash.update((after,))
        if after != before:
            size = max(s for _, sha256, s in arrived if sha256 == after)
            yield Row(path=key[0], sha256=after, size_bytes=size if size >= 0 else None, known=before)

    def close(self) -> None:
        pass


def changed_arrivals(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(path, sha256, size_bytes, known) of arrivals whose hash the state doesn't have.

    ``files`` is a stream of (path, content, arrived). Of two contents of one
    path in a micro-batch that of the larger ``arrived`` counts, null being the
    least, of equal ones that of the larger hash. ``known`` is the hash before,
    null for a new path. ``manifest`` is a stream of (path, sha256) recorded
    elsewhere, such as an earlier run's; it counts before the arrivals of its
    micro-batch. Contents are hashed in the scan and go no further. An unreadable
    file has the empty hash; a null path is a path like any other.
    """
    content = changes.fingerprints(files.withColumn("path", F.struct("path", "arrived")))
    least = F.lit(-(1 << 63))
    rows = content.select(
        F.col("path.path").alias("path"), "sha256", F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"),
        F.coalesce(F.col("path.arrived"), least).alias("arrived"), F.lit(False).alias("recorded"))
    if manifest is not None:
        rows = rows.unionByName(manifest.select(
            "path", "sha256", F.lit(-1).cast("bigint").alias("size_bytes"), least.alias("arrived"), F.lit(True).alias("recorded")))
    return rows.groupBy("path").transformWithState(_Newest(), CHANGED, "Update", "None")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State of any size on the executors' disks, with its changes in the checkpoint folder."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def follow_manifest(spark: SparkSession, landing: str, checkpoint: str, handle: Callable[[DataFrame, int], None],
                    manifest: str | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Work through what has landed, then stop.

    ``handle(changed, batch)`` gets the changed rows of each micro-batch, again
    with the same number and rows if it fails. ``manifest`` is a folder with the
    hashes (path, sha256) that are known already; all of it counts in the first
    micro-batch.
    """
    with rocksdb_state(spark):
        arrivals = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
        known = spark.readStream.schema(schemas.MANIFEST).parquet(manifest) if manifest else None
        return changed_arrivals(arrivals, known).writeStream.outputMode("update").foreachBatch(handle).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_writer(out: str) -> Callable[[DataFrame, int], None]:
    """A ``handle`` that keeps a folder a micro-batch: a replayed one overwrites what it left."""
    return lambda changed, batch: changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def manifest_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path, sha256) as the state has it after the last finished micro-batch."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    return state.select(F.col("key.path").alias("path"), F.col("value.sha256").alias("sha256"))
