"""Time slices by load, for addresses that send very many events within one.

The detectors deal raw rows out by (address, slice), see ``velocity``. A slice
of fixed length bounds what a whole day of one address brings to a task, but
not a burst within it. Here slices with more events than a task should sort are
cut where the events lie: events are counted per millisecond, and a part ends
when it is full. The part is kept as the column in which the detectors look for
a stored slice, so they need no change and give the same rows.

Slices are counted with map-side combine; only crowded ones are counted again
by millisecond, at most as many rows as a slice has milliseconds. The table of
cuts is broadcast: a part is as large as the number of all events divided by
``MOST_PARTS`` at least, so it can't have more than twice as many cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicksieve.functions.columns import millis
from clicksieve.operators.velocity import ADDRESS, SLICE_SECONDS, stored_slice, time_slice
from clicksieve.session import work_folder
from clicksieve.sources import tables

ROWS_PER_PART = 1_000_000  # what a task sorts of one address
MOST_PARTS = 100_000  # of all addresses; larger inputs get larger parts


def part_size(events: int, rows_per_part: int = ROWS_PER_PART) -> int:
    return max(rows_per_part, -(-events // MOST_PARTS))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & left[name].eqNullSafe(right[f"_{name}"])
    return condition


def cuts(logs: DataFrame, keys: Sequence[str], slice_seconds: int, rows_per_part: int) -> DataFrame:
    """Keys and slice, with a leading underscore, of each crowded slice, and ``_cuts``.

    ``_cuts`` are the sorted times, in milliseconds since 1970, at which its
    parts begin. A part has fewer than ``rows_per_part`` events before its last
    millisecond; events of one millisecond stay together.
    """
    in_slice = [*keys, "_slice"]
    events = logs.select(*keys, time_slice(slice_seconds).alias("_slice"), millis(F.col("timestamp")).alias("_ms"))
    crowded = (
        events.groupBy(*in_slice).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_part)
        .select(*[F.col(c).alias(f"_{c}") for c in in_slice])
    )
    # fewer rows than all events divided by rows_per_part
    within = events.join(F.broadcast(crowded), _same(events, crowded, in_slice), "left_semi")
    before = Window.partitionBy(*in_slice).orderBy("_ms").rowsBetween(Window.unboundedPreceding, -1)
    counted = within.groupBy(*in_slice, "_ms").agg(F.count(F.lit(1)).alias("_n"))
    part = F.expr(f"coalesce(_before, 0) div {int(rows_per_part)}")
    parts = counted.withColumn("_before", F.sum("_n").over(before)).groupBy(*in_slice, part.alias("_part")).agg(F.min("_ms").alias("_at"))
    return parts.groupBy(*in_slice).agg(F.sort_array(F.collect_list("_at")).alias("_cuts")).select(
        *[F.col(c).alias(f"_{c}") for c in in_slice], "_cuts"
    )


def with_load_slices(
    logs: DataFrame, keys: Sequence[str] = ADDRESS, slice_seconds: int = SLICE_SECONDS, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """The rows with the part of their slice in the column that ``slice_of`` looks for.

    A part is named by the millisecond at which it begins, so parts are in the
    order of time. Rows whose keys are null belong together. Two more scans of
    keys and time come before the detector's own.
    """
    size = part_size(logs.count(), rows_per_part)
    spark = logs.sparkSession
    found = tables.overwrite(cuts(logs, keys, slice_seconds, size), work_folder(spark, "slice-cuts"))
    sliced = logs.withColumn("_slice", time_slice(slice_seconds))
    begun = F.element_at(F.filter("_cuts", lambda at: at <= millis(F.col("timestamp"))), -1)
    part = F.coalesce(begun, F.col("_slice") * (slice_seconds * 1000))
    joined = sliced.join(F.broadcast(found), _same(sliced, found, [*keys, "_slice"]), "left")
    kept = [F.col(c) for c in logs.columns if c != stored_slice(slice_seconds)]
    return joined.select(*kept, part.alias(stored_slice(slice_seconds)))
