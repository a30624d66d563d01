"""Click gaps kept per address and hour, and statistics of any trailing window from them.

A run over the last day has to read the day's logs again, although 23 of its 24
hours were read an hour ago. Here an hour is read once: what stays of it is one
row per address with counts, extremes and a quantile sketch of its gaps.
Sketches of several hours merge, so a window costs one small row per address
and hour, and any window of whole hours can be asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicksieve.functions.columns import AsOf, hours_before
from clicksieve.operators.velocity import ADDRESS, with_previous_event
from clicksieve.rules import DETECTION, DetectionRules

HOUR = "event_hour"
SKETCH_SIZE = 400
RANK_ERROR = 0.015  # of the median of merged sketches of SKETCH_SIZE, as a share of the gaps; 99 % of sketches are within 0.7 %


def hourly_gaps(
    logs: DataFrame,
    keys: Sequence[str] = ADDRESS,
    rules: DetectionRules = DETECTION,
    since: AsOf | None = None,
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """One row per address and hour: clicks, fastest_click_ms, ultra_fast_clicks, gap_sum, gaps (a sketch).

    A gap belongs to the hour of its later event, wherever the earlier one
    lies; the first event of an address has none. ``since`` leaves out hours
    before it, whose events only serve as earlier ones: to add an hour, read
    the logs from where every address has an event before it.
    Sketches are built where the rows are and merged, so a hot address does not
    gather in one task.
    """
    gaps = with_previous_event(logs, keys).where(F.col("time_diff_ms").isNotNull())
    gaps = gaps.select(*keys, F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias(HOUR), F.col("time_diff_ms").alias("gap"))
    if since is not None:
        gaps = gaps.where(F.col(HOUR) >= hours_before(since, 0).cast("timestamp_ntz"))
    return gaps.groupBy(*keys, HOUR).agg(
        F.count(F.lit(1)).alias("clicks"),
        F.min("gap").alias("fastest_click_ms"),
        F.count_if(F.col("gap") < rules.ultra_fast_gap_ms).alias("ultra_fast_clicks"),
        F.sum("gap").alias("gap_sum"),
        F.kll_sketch_agg_bigint("gap", F.lit(size)).alias("gaps"),
    )


def window_metrics(
    hours: DataFrame, as_of: AsOf, keys: Sequence[str] = ADDRESS, rules: DetectionRules = DETECTION, size: int = SKETCH_SIZE
) -> DataFrame:
    """Gap statistics of the trailing window from kept hours; the median is approximate.

    ``median_click_ms`` is a gap that occurs, whose rank is off by at most
    ``RANK_ERROR`` of the gaps, and exact while a window has no more gaps than
    a sketch holds. Sketches choose at random what they keep, so a run again
    may give another gap within the bound. The other columns are exact.
    ``as_of`` should be a whole hour; otherwise the first hour counts only if
    it begins inside the window.
    """
    since = hours_before(as_of, rules.window_hours).cast("timestamp_ntz")
    return (
        hours.where(F.col(HOUR) >= since)
        .groupBy(*keys)
        .agg(
            F.sum("clicks").alias("total_clicks"),
            F.min("fastest_click_ms").alias("fastest_click_ms"),
            F.sum("ultra_fast_clicks").alias("ultra_fast_clicks"),
            F.sum("gap_sum").alias("_gap_sum"),
            F.kll_merge_agg_bigint("gaps", F.lit(size)).alias("_gaps"),
        )
        .select(
            *keys,
            "total_clicks",
            "fastest_click_ms",
            (F.col("_gap_sum").cast("double") / F.col("total_clicks").cast("double")).alias("avg_click_interval_ms"),
            F.kll_sketch_get_quantile_bigint("_gaps", F.lit(0.5)).alias("median_click_ms"),
            "ultra_fast_clicks",
        )
    )


def median_rank(metrics: DataFrame, gaps: DataFrame, keys: Sequence[str] = ADDRESS) -> DataFrame:
    """How far a median is from the middle: keys and ``off``, a share of the address's ``gaps`` (column ``time_diff_ms``).

    0 where half of the gaps are not above it and half are not below it. Gaps
    without an address have no row.
    Gaps are counted per length before they meet the medians, so a hot address
    brings few rows.
    """
    counts = gaps.where(F.col("time_diff_ms").isNotNull()).groupBy(*keys, "time_diff_ms").agg(F.count(F.lit(1)).alias("n"))
    gap, median = F.col("time_diff_ms"), F.col("median_click_ms")
    joined = counts.join(metrics.select(*keys, "median_click_ms"), list(keys))
    n = F.sum("n")
    below, above = F.sum(F.when(gap < median, F.col("n")).otherwise(0)), F.sum(F.when(gap > median, F.col("n")).otherwise(0))
    return joined.groupBy(*keys).agg(F.greatest(F.lit(0.0), below / n - 0.5, above / n - 0.5).alias("off"))
