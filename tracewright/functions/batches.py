"""The size of the batches in which rows go to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of one Arrow batch; with whole texts this bounds a Python worker's memory.
BATCH_ROWS = 1024

#: Bytes of one Arrow batch, about: long texts make for fewer rows.
BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower Arrow's batches to BATCH_ROWS and about BATCH_BYTES, so that whole texts fit a worker."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
