"""The incremental batch fed by a file stream.

The data model has no event time: nothing here is windowed. Each micro-batch
is one incremental run over the files that arrived since the last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillframe.operators import changes
from quillframe.plans import incremental

ARRIVALS = "path string, content string, arrived long"


def process_arrivals(
    spark: SparkSession,
    landing: str,
    state_root: str,
    checkpoint: str,
    handle: Callable[[DataFrame, DataFrame], None],
    files_per_batch: int = 1000,
):
    """Work through what has landed, then stop.

    ``handle(pending, files)`` gets the changed rows of a batch and the batch.
    ``arrived`` says which of two contents of a path is newer, within a batch.
    Hashes are recorded after it returns, so a batch replayed after a failure
    finds its files still pending: ``handle`` must be safe to repeat.
    """

    def one_batch(files: DataFrame, batch_id: int) -> None:
        files = changes.latest(files, "arrived")
        pending = incremental.pending_files(files, state_root)
        handle(pending, files)
        incremental.record_hashes(files, state_root)

    return (
        spark.readStream.schema(ARRIVALS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(landing)
        .writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
