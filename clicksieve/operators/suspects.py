"""Merge of the two detectors into one row per suspect address."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicksieve.functions.columns import AsOf, Verdict, as_timestamp
from clicksieve.rules import DETECTION, DetectionRules

ADDRESS = ("ip_address",)


def combine_detectors(volume: DataFrame, velocity: DataFrame, keys: Sequence[str] = ADDRESS) -> DataFrame:
    """Both suspect lists in one layout.

    No ``distinct``: each side has one row per address and the method name
    differs, so duplicates cannot exist.
    """
    def laid_out(suspects: DataFrame, method: str) -> DataFrame:
        verdict = Verdict(F.lit(True), F.col("fraud_flags"), F.col("fraud_reason"))
        return suspects.select(*keys, F.inline(F.array(combined_row(method, F.col, verdict))))

    return laid_out(volume, "HIGH_VOLUME").unionByName(laid_out(velocity, "HIGH_VELOCITY"))


def combined_row(method: str, value: Callable[[str], Column], verdict: Verdict) -> Column:
    """A detector's find in the layout that both share, as a struct; ``value`` gives its metrics."""
    by_volume = method == "HIGH_VOLUME"
    missing, no_mean = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    return F.struct(
        value("total_events" if by_volume else "total_clicks").alias("total_clicks"),
        (value("distinct_uas") if by_volume else missing).alias("distinct_uas"),
        (missing if by_volume else value("fastest_click_ms")).alias("fastest_click_ms"),
        (no_mean if by_volume else value("avg_click_interval_ms")).alias("avg_click_interval_ms"),
        verdict.flags.alias("fraud_flags"),
        verdict.reason.alias("fraud_reason"),
        *[value(c).alias(c) for c in ("country_code", "device_type", "first_seen", "last_seen")],
        F.lit(method).alias("detection_method"),
    )


def merge_suspects(combined: DataFrame, keys: Sequence[str] = ADDRESS) -> DataFrame:
    """One row per address; the lists hold at most two detectors' entries each.

    ``total_clicks`` adds both detectors' counts and so counts an address twice
    when both caught it. Scoring depends on that sum; ``events_total`` beside
    it is the plain number of events.
    """
    by_volume = F.col("detection_method") == "HIGH_VOLUME"
    return combined.groupBy(*keys).agg(
        F.sum("total_clicks").alias("total_clicks"),
        F.coalesce(
            F.max(F.when(by_volume, F.col("total_clicks"))), F.max("total_clicks") + 1
        ).alias("events_total"),
        F.max("distinct_uas").alias("distinct_uas"),
        F.min("fastest_click_ms").alias("fastest_click_ms"),
        F.avg("avg_click_interval_ms").alias("avg_click_interval_ms"),
        F.sort_array(F.flatten(F.collect_list("fraud_flags"))).alias("all_fraud_flags"),
        F.sort_array(F.collect_set("fraud_reason")).alias("fraud_reasons"),
        F.sort_array(F.collect_set("detection_method")).alias("detection_methods"),
        F.min("country_code").alias("country_code"),
        F.min("device_type").alias("device_type"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def merged_row(volume: Column, velocity: Column) -> dict[str, Column]:
    """What ``merge_suspects`` makes of both detectors' rows of an address, here side by side; one may be null."""
    rows = F.array_compact(F.array(volume, velocity))
    each = lambda name: F.transform(rows, lambda row: row[name])
    return {
        "total_clicks": F.coalesce(volume["total_clicks"], F.lit(0)) + F.coalesce(velocity["total_clicks"], F.lit(0)),
        "events_total": F.coalesce(volume["total_clicks"], velocity["total_clicks"] + 1),
        "distinct_uas": volume["distinct_uas"],
        "fastest_click_ms": velocity["fastest_click_ms"],
        "avg_click_interval_ms": velocity["avg_click_interval_ms"],
        "all_fraud_flags": F.sort_array(F.flatten(each("fraud_flags"))),
        "fraud_reasons": F.sort_array(F.array_distinct(each("fraud_reason"))),
        "detection_methods": F.sort_array(each("detection_method")),
        "country_code": F.array_min(each("country_code")),
        "device_type": F.array_min(each("device_type")),
        "first_seen": F.array_min(each("first_seen")),
        "last_seen": F.array_max(each("last_seen")),
    }


def primary_reason(reasons: Column, rules: DetectionRules = DETECTION) -> Column:
    """Strongest reason present; failing those, the first in sorted order."""
    named = [F.when(F.array_contains(reasons, name), F.lit(name)) for name in rules.reason_priority]
    return F.coalesce(*named, F.get(reasons, F.lit(0)))


def finish_suspects(merged: DataFrame, detected_at: AsOf, rules: DetectionRules = DETECTION) -> DataFrame:
    flags = F.slice(F.array_sort(F.array_distinct("all_fraud_flags")), 1, rules.max_flags)
    return (
        merged.withColumns(
            {
                "fraud_flags": flags,
                "primary_fraud_reason": primary_reason(F.col("fraud_reasons"), rules),
                "detected_at": as_timestamp(detected_at).cast("timestamp_ntz"),
            }
        )
        .drop("all_fraud_flags")
    )


def filtering_summary(suspects: DataFrame) -> DataFrame:
    return suspects.agg(
        F.lit("FILTERING_COMPLETE").alias("status"),
        F.count(F.lit(1)).alias("total_suspects"),
        F.count_distinct("primary_fraud_reason").alias("fraud_types_detected"),
        F.sum("total_clicks").alias("total_suspicious_clicks"),
        F.avg("total_clicks").alias("avg_clicks_per_suspect"),
        F.count_distinct("country_code").alias("affected_countries"),
        F.min("detected_at").alias("detection_timestamp"),
    )


def top_suspects(suspects: DataFrame, n: int = 20) -> DataFrame:
    """The n busiest suspects. The address breaks ties, so the report is repeatable."""
    return suspects.orderBy(F.desc("total_clicks"), "ip_address").limit(n)
