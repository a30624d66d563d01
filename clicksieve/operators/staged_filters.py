"""The documented three-stage filter and the rates it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicksieve.functions.columns import AsOf, days_before, ratio
from clicksieve.rules import STAGED_FILTERS, StagedFilterRules


def engagement_rates(
    logs: DataFrame,
    clicks: tuple[str, ...] = ("click",),
    impressions: tuple[str, ...] = ("impression", "view"),
    conversions: tuple[str, ...] = ("conversion", "purchase"),
) -> DataFrame:
    """Click-through and conversion rate per address.

    One map-side combined pass. CTR is clicks per impression, conversion rate
    conversions per click; NULL without a denominator.
    """
    kind = F.col("event_type")
    counted = logs.groupBy("ip_address").agg(
        F.count_if(kind.isin(*clicks)).alias("clicks"),
        F.count_if(kind.isin(*impressions)).alias("impressions"),
        F.count_if(kind.isin(*conversions)).alias("conversions"),
    )
    return counted.withColumns(
        {
            "ctr": ratio(F.col("clicks"), F.col("impressions")),
            "conversion_rate": ratio(F.col("conversions"), F.col("clicks")),
        }
    )


def basic_filter(metrics: DataFrame, as_of: AsOf, rules: StagedFilterRules = STAGED_FILTERS) -> DataFrame:
    """Stage 1: enough clicks, too fast, seen recently. Works on velocity metrics."""
    today_minus = days_before(as_of, rules.recent_days).cast("date")
    return metrics.where(
        (F.col("total_clicks") > rules.min_clicks)
        & (F.col("fastest_click_ms") < rules.fastest_below_ms)
        & (F.col("last_seen").cast("date") >= today_minus)
    )


def without_trusted(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows whose address is not on the allow list.

    An anti join, so a NULL in the list removes nothing. There is no broadcast
    hint: the list may grow, and Spark broadcasts it only below its own size
    limit and otherwise shuffles. ``rows`` has one row per address, hence no
    hot key either way.
    """
    return rows.join(trusted.select("ip_address"), "ip_address", "left_anti")


def quality_filter(rates: DataFrame, trusted: DataFrame, rules: StagedFilterRules = STAGED_FILTERS) -> DataFrame:
    """Stage 2: plausible rates, not on the allow list."""
    low, high = rules.ctr_between
    kept = rates.where(F.col("ctr").between(low, high) & (F.col("conversion_rate") < rules.conversion_below))
    return without_trusted(kept, trusted)


def fraud_filter(scored: DataFrame, bot_probability: Column, rules: StagedFilterRules = STAGED_FILTERS) -> DataFrame:
    """Stage 3: any of three scores is high. The caller supplies the bot probability."""
    return scored.where(
        (F.col("risk_score") > rules.risk_above)
        | (bot_probability > rules.bot_probability_above)
        | (F.col("velocity_score") > rules.velocity_above)
    )
