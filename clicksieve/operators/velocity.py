"""Velocity detector: addresses whose clicks follow each other too fast.

The gap before a click needs the previous click of the same address, which
looks like a window over the whole address. One address may hold a third of all
rows, so no plan here sorts an address in one task:

* rows are shuffled by (address, time slice) and LAG runs inside the slice;
* each slice is then reduced to one row per different gap length, and only
  these rows are shuffled by address to close the gaps between slices.

Gaps are whole milliseconds inside a slice, so a slice has at most
sqrt(2 * slice length in ms) different ones and a day at most about half a
million rows however many events it holds: the per-address step is bounded by
the clock and not by the traffic. The same argument bounds the exact median:
24 hours hold at most 13,145 different gap lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicksieve.functions.columns import Verdict, flag_list, millis
from clicksieve.rules import DETECTION, DetectionRules

ADDRESS = ("ip_address",)
SLICE_SECONDS = 60
_SLICE = "_slice"


def time_slice(seconds: int = SLICE_SECONDS) -> Column:
    return F.expr(f"unix_millis(cast(timestamp as timestamp)) div {int(seconds) * 1000}")


def stored_slice(seconds: int = SLICE_SECONDS) -> str:
    """The column in which a bucketed table keeps the slice."""
    return f"slice_{int(seconds)}s"


def slice_of(logs: DataFrame, seconds: int = SLICE_SECONDS) -> Column:
    """The slice of a row: from the table if it keeps it, so its buckets serve as the exchange."""
    return F.col(stored_slice(seconds)) if stored_slice(seconds) in logs.columns else time_slice(seconds)


def with_previous_event(
    logs: DataFrame,
    keys: Sequence[str] = ADDRESS,
    tie_break: Sequence[str] = ("bid_request_id",),
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Every row with the time of the previous event of its address.

    Adds ``prev_timestamp`` and ``time_diff_ms``; both are NULL for the first
    event. Only the first row of a slice, with the slice's end, goes through a
    window over the address, so no row is joined and none with a NULL key lost.
    """
    sliced = logs.withColumn(_SLICE, slice_of(logs, slice_seconds))
    in_slice = Window.partitionBy(_SLICE, *keys).orderBy("timestamp", *tie_break)
    whole_slice = in_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_address = Window.partitionBy(*keys).orderBy(_SLICE)
    rows = sliced.withColumn("prev_timestamp", F.lag("timestamp").over(in_slice)).withColumn(
        "_place", F.row_number().over(in_slice)
    ).withColumn("_end", F.max("timestamp").over(whole_slice))
    later = rows.where(F.col("_place") > 1)
    # one row per slice goes through the address; it carries the slice's end for the next
    first = rows.where(F.col("_place") == 1).withColumn("prev_timestamp", F.lag("_end").over(by_address))
    previous = F.col("prev_timestamp")
    return later.unionByName(first).select(
        *[F.col(c) for c in logs.columns],
        previous,
        (millis(F.col("timestamp")) - millis(previous)).alias("time_diff_ms"),
    )


def gap_counts(
    logs: DataFrame, keys: Sequence[str] = ADDRESS, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """All gaps between consecutive events: one row per (address, slice, gap, place).

    Columns: keys, ``gap_ms``, ``clicks`` (how many events follow such a gap),
    ``first_ts``, ``last_ts``, ``country_code``, ``device_type``. The first
    event of an address has no gap and is left out.

    Two exchanges: raw rows by (address, slice), reduced rows by address. The
    aggregation between them needs none of its own. Country and device are
    grouping columns because a string among the aggregates would turn the hash
    aggregation into a sort.
    """
    # slice first: it is a number, and sorting compares the first column fastest
    by_slice = [_SLICE, *keys]
    in_slice = Window.partitionBy(*by_slice).orderBy("timestamp")
    earlier_slices = (
        Window.partitionBy(*keys).orderBy(_SLICE).rangeBetween(Window.unboundedPreceding, -1)
    )
    gap_in_slice = millis(F.col("timestamp")) - millis(F.lag("timestamp").over(in_slice))
    reduced = (
        logs.select(*keys, "timestamp", "country_code", "device_type", slice_of(logs, slice_seconds).alias(_SLICE))
        .withColumn("gap_ms", gap_in_slice)
        .groupBy(*by_slice, "gap_ms", "country_code", "device_type")
        .agg(
            F.count(F.lit(1)).alias("clicks"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
        )
    )
    gap_to_earlier = millis(F.col("first_ts")) - millis(F.max("last_ts").over(earlier_slices))
    return (
        reduced.withColumn("_between", gap_to_earlier)
        .withColumn("gap_ms", F.coalesce("gap_ms", "_between"))
        .where(F.col("gap_ms").isNotNull())
        .drop("_between", _SLICE)
    )


def velocity_metrics(
    logs: DataFrame,
    keys: Sequence[str] = ADDRESS,
    rules: DetectionRules = DETECTION,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Gap statistics per address; an address with a single event has no row.

    ``total_clicks`` and ``first_seen`` leave out the first event, which has no
    gap. The deviation comes from the sum of squares: within a day that stays
    below 2**53, so the double sum is exact and does not depend on the order in
    which tasks finish, and only the difference per address needs decimals.
    """
    grouped = gap_counts(logs, keys, slice_seconds).groupBy(*keys).agg(
        *[column.alias(name) for name, column in gap_sums(rules).items()]
    )
    return grouped.select(*keys, *[column.alias(name) for name, column in gap_statistics().items()])


def gap_sums(rules: DetectionRules = DETECTION, only: Column | None = None) -> dict[str, Column]:
    """Aggregates over the rows of ``gap_counts``, or over those rows of a frame where ``only`` holds."""

    def of(value: Column) -> Column:
        return value if only is None else F.when(only, value)

    gap, clicks = F.col("gap_ms"), F.col("clicks")
    wide_gap = gap.cast("double")
    return {
        "total_clicks": F.sum(of(clicks)),
        "fastest_click_ms": F.min(of(gap)),
        "_gap_sum": F.sum(of(gap * clicks)),
        "_gap_sq": F.sum(of(wide_gap * wide_gap * clicks)),
        # rows without a gap do not count in a percentile
        "median_click_ms": F.percentile(of(gap), F.lit(0.5), clicks),
        "ultra_fast_clicks": F.sum(of(F.when(gap < rules.ultra_fast_gap_ms, clicks).otherwise(0))),
        "very_fast_clicks": F.sum(of(F.when(gap < rules.very_fast_gap_ms, clicks).otherwise(0))),
        "country_code": F.min(of(F.col("country_code"))),
        "device_type": F.min(of(F.col("device_type"))),
        "first_seen": F.min(of(F.col("first_ts"))),
        "last_seen": F.max(of(F.col("last_ts"))),
    }


def gap_statistics() -> dict[str, Column]:
    """The metrics of an address from its ``gap_sums``."""
    n, total = F.col("total_clicks"), F.col("_gap_sum")
    exact_total = total.cast("decimal(18,0)")
    spread = F.col("_gap_sq").cast("decimal(25,0)") * n.cast("decimal(13,0)") - exact_total * exact_total
    pairs = n.cast("double") * (n - 1).cast("double")
    variance = F.greatest(spread.cast("double"), F.lit(0.0)) / F.nullif(pairs, F.lit(0.0))
    plain = (
        "ultra_fast_clicks", "very_fast_clicks", "country_code", "device_type", "first_seen", "last_seen",
    )
    return {
        "total_clicks": n,
        "fastest_click_ms": F.col("fastest_click_ms"),
        "avg_click_interval_ms": total.cast("double") / n.cast("double"),
        "median_click_ms": F.col("median_click_ms"),
        "click_interval_stddev": F.sqrt(variance),
    } | {name: F.col(name) for name in plain}


def velocity_verdict(value: Callable[[str], Column] = F.col, rules: DetectionRules = DETECTION) -> Verdict:
    """Whether metrics are over any entry cut-off, and why. Speed flags add up."""
    fastest, ultra = value("fastest_click_ms"), value("ultra_fast_clicks")
    inhuman = fastest < rules.inhuman_gap_ms
    bot_like = fastest < rules.ultra_fast_gap_ms
    suspicious = fastest < rules.very_fast_gap_ms
    repeated = ultra > rules.repeated_ultra_fast
    sustained = value("avg_click_interval_ms") < rules.sustained_avg_gap_ms
    return Verdict(
        suspicious | repeated | sustained,
        flag_list(
            (inhuman, "INHUMAN_SPEED"),
            (bot_like, "BOT_LIKE_SPEED"),
            (suspicious, "SUSPICIOUS_SPEED"),
            (repeated, "REPEATED_ULTRA_FAST"),
            (sustained, "CONSISTENTLY_FAST"),
        ),
        F.coalesce(
            F.when(inhuman, "INHUMAN_VELOCITY_BOT"),
            F.when(bot_like, "HIGH_VELOCITY_BOT"),
            F.when(suspicious, "SUSPICIOUS_VELOCITY"),
            F.when(repeated, "REPEATED_FAST_PATTERN"),
            F.lit("VELOCITY_ANOMALY"),
        ),
    )


def flag_high_velocity(metrics: DataFrame, rules: DetectionRules = DETECTION) -> DataFrame:
    """Keep addresses over any entry cut-off and say why."""
    return velocity_verdict(rules=rules).kept(metrics)


def high_velocity_suspects(
    logs: DataFrame, rules: DetectionRules = DETECTION, keys: Sequence[str] = ADDRESS
) -> DataFrame:
    return flag_high_velocity(velocity_metrics(logs, keys, rules), rules)


def velocity_phase_summary(suspects: DataFrame) -> DataFrame:
    return suspects.agg(
        F.lit("HIGH_VELOCITY_FILTER").alias("filter_phase"),
        F.count(F.lit(1)).alias("suspect_count"),
        F.avg("fastest_click_ms").alias("avg_fastest_click"),
        F.min("fastest_click_ms").alias("min_fastest_click"),
        F.sum("ultra_fast_clicks").alias("total_ultra_fast_clicks"),
    )
