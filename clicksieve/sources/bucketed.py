"""Logs as a bucketed catalog table, which the detectors read without shuffling raw rows.

Buckets are by (minute, address), the key by which the detectors deal raw rows
out. Buckets by address alone would put a hot address into one file; by minute
and address it is spread over all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicksieve.operators.velocity import ADDRESS, SLICE_SECONDS, stored_slice, time_slice
from clicksieve.sources.bid_logs import EVENT_DATE, writing_tasks


def write_bucketed(
    logs: DataFrame,
    table: str,
    buckets: int,
    keys: Sequence[str] = ADDRESS,
    slice_seconds: int = SLICE_SECONDS,
    path: str | None = None,
) -> DataFrame:
    """Store logs as catalog table ``table`` by date, bucketed by (slice, keys), and return the stored rows.

    Rows are shuffled once, here; a task writes one bucket, so there is a file
    for each date and bucket. ``buckets`` is the least number; larger logs get
    one per ``ROWS_PER_TASK`` rows, as a bucket is sorted by one task. The table keeps the slice in a column of its own,
    named for its length; detectors asked for that length use it.
    """
    buckets = writing_tasks(logs.select("timestamp"), buckets)
    by = [stored_slice(slice_seconds), *keys]
    sliced = logs.withColumn(by[0], time_slice(slice_seconds)).withColumn(EVENT_DATE, F.col("timestamp").cast("date"))
    writer = sliced.repartition(buckets, *by).write.mode("overwrite").format("parquet").partitionBy(EVENT_DATE)
    writer = writer.bucketBy(buckets, *by).sortBy(*by, "timestamp")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return logs.sparkSession.table(table)
