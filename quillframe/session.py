"""Session settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole files travel to Python workers: bound batches by bytes, not rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def build_session(app: str = "quillframe", master: str | None = None, **conf) -> SparkSession:
    """A session with ``SETTINGS``; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def bound_batches(spark: SparkSession, most: int | None = None) -> None:
    """Bound Arrow batches by ``most`` bytes (as in ``SETTINGS``) in a session made elsewhere.

    Called by the operators that send whole texts to Python workers: a batch of
    10,000 large files would not fit a worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    current, most = _bytes(spark.conf.get(key)), most or _bytes(SETTINGS[key])
    if current <= 0 or current > most:
        spark.conf.set(key, str(most))


def _bytes(setting: str) -> int:
    digits = "".join(c for c in setting if c.isdigit() or c == "-")
    unit = setting[len(digits):].strip().lower()[:1]
    return int(digits) * {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit]
