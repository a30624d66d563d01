"""Risk score of a suspect: four component scores, a level and a confidence.

Everything is a column expression over the suspect row; scoring adds no
exchange and stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicksieve.functions.columns import AsOf, as_timestamp, exact_mean, lookup, tiered
from clicksieve.rules import (
    RATIO_SCORES,
    SCORING,
    SIGNAL_WEIGHTS,
    RatioScoreRules,
    ScoringRules,
    SignalWeightRules,
)


def clamp_unit(score: Column) -> Column:
    """The score cut to [0, 1]; NULL stays NULL, which least() and greatest() would skip."""
    return F.when(score > 1, F.lit(1.0)).when(score < 0, F.lit(0.0)).otherwise(score)


def base_score(reason: Column, rules: ScoringRules = SCORING) -> Column:
    return lookup(reason, rules.base_scores, rules.base_otherwise)


def velocity_score(fastest_ms: Column, rules: ScoringRules = SCORING) -> Column:
    known = tiered(fastest_ms, rules.velocity_below, rules.velocity_otherwise, at_least=False)
    return F.when(fastest_ms.isNull(), F.lit(rules.velocity_missing)).otherwise(known)


def volume_score(clicks: Column, rules: ScoringRules = SCORING) -> Column:
    return tiered(clicks, rules.volume_at_least, rules.volume_otherwise, at_least=True)


def ua_rotation_score(distinct_uas: Column, rules: ScoringRules = SCORING) -> Column:
    known = tiered(distinct_uas, rules.ua_at_least, rules.ua_otherwise, at_least=True)
    return F.when(distinct_uas.isNull(), F.lit(rules.ua_missing)).otherwise(known)


def weighted_score(base: Column, velocity: Column, volume: Column, ua: Column, rules: ScoringRules = SCORING) -> Column:
    """Weighted sum in double, added from left to right.

    The order matters: for a few component combinations that land on a cut-off
    another order, or decimal arithmetic, gives another level.
    """
    return clamp_unit(
        base * F.lit(rules.base_weight)
        + velocity * F.lit(rules.velocity_weight)
        + volume * F.lit(rules.volume_weight)
        + ua * F.lit(rules.ua_weight)
    )


def risk_level(score: Column, rules: ScoringRules = SCORING) -> Column:
    return tiered(score, rules.level_at_least, rules.level_otherwise, at_least=True)


def confidence(fastest_ms: Column, distinct_uas: Column, clicks: Column, rules: ScoringRules = SCORING) -> Column:
    """High when both signals are present on enough clicks, medium with either."""
    timed, seen = fastest_ms.isNotNull(), distinct_uas.isNotNull()
    return (
        F.when(timed & seen & (clicks >= rules.full_confidence_clicks), F.lit(rules.full_confidence))
        .when(timed | seen, F.lit(rules.partial_confidence))
        .otherwise(F.lit(rules.low_confidence))
    )


def score_components(suspects: DataFrame, rules: ScoringRules = SCORING) -> DataFrame:
    return suspects.withColumns(
        {
            "base_risk_score": base_score(F.col("primary_fraud_reason"), rules),
            "velocity_score": velocity_score(F.col("fastest_click_ms"), rules),
            "volume_score": volume_score(F.col("total_clicks"), rules),
            "ua_rotation_score": ua_rotation_score(F.col("distinct_uas"), rules),
        }
    )


def risk_scores(suspects: DataFrame, scored_at: AsOf, rules: ScoringRules = SCORING) -> DataFrame:
    """The stored score table, 18 columns."""
    components = (F.col(c) for c in ("base_risk_score", "velocity_score", "volume_score", "ua_rotation_score"))
    score = F.col("risk_score")
    return (
        score_components(suspects, rules)
        .withColumn("risk_score", weighted_score(*components, rules=rules))
        .select(
            "ip_address",
            "risk_score",
            risk_level(score, rules).alias("risk_level"),
            "velocity_score",
            "volume_score",
            "ua_rotation_score",
            (score >= rules.fraud_flag_at_least).alias("fraud_flag"),
            confidence(
                F.col("fastest_click_ms"), F.col("distinct_uas"), F.col("total_clicks"), rules
            ).alias("confidence_level"),
            "country_code",
            "device_type",
            "total_clicks",
            "distinct_uas",
            "fastest_click_ms",
            "fraud_reasons",
            "detection_methods",
            F.lit(True).alias("is_processed"),
            "detected_at",
            as_timestamp(scored_at).cast("timestamp_ntz").alias("scored_at"),
        )
    )


def risk_level_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_level").agg(
        exact_mean(F.col("risk_score")).alias("avg_risk_score"),
        F.count("ip_address").alias("ip_count"),
    )


def critical_high_counts(scores: DataFrame) -> DataFrame:
    """Addresses that need action, counted in one pass."""
    critical = F.count_if(F.col("risk_level") == "CRITICAL")
    high = F.count_if(F.col("risk_level") == "HIGH")
    return scores.agg(
        critical.alias("critical_count"),
        high.alias("high_count"),
        (critical + high).alias("action_required"),
    )


# Documented alternative scores -------------------------------------------------


def device_variety(logs: DataFrame) -> DataFrame:
    """Different device types per address."""
    return logs.groupBy("ip_address").agg(F.count_distinct("device_type").alias("distinct_devices"))


def signal_weight_score(
    suspects: DataFrame,
    devices: DataFrame,
    suspicious_countries: tuple[str, ...],
    rules: SignalWeightRules = SIGNAL_WEIGHTS,
) -> DataFrame:
    """Sum of the weights of the signals that are present.

    Both sides have one row per address, so the join has no hot key; whether
    it becomes a broadcast is left to the measured sizes.
    """
    reasons = F.col("fraud_reasons")
    terms = [
        F.when(F.array_contains(reasons, name), F.lit(weight)).otherwise(F.lit(0.0))
        for name, weight in rules.reason_weights
    ]
    odd_country = F.col("country_code").isin(*suspicious_countries)
    terms.append(F.when(odd_country, F.lit(rules.suspicious_country_weight)).otherwise(F.lit(0.0)))
    odd_device = F.col("distinct_devices") > 1
    terms.append(F.when(odd_device, F.lit(rules.device_anomaly_weight)).otherwise(F.lit(0.0)))
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    joined = suspects.join(devices, "ip_address", "left")
    return (
        joined.withColumn("signal_score", clamp_unit(total))
        .withColumn("signal_level", risk_level(F.col("signal_score")))
        .select("ip_address", "fraud_reasons", "country_code", "distinct_devices", "signal_score", "signal_level")
    )


def ratio_score(metrics: DataFrame, reputation: DataFrame, rules: RatioScoreRules = RATIO_SCORES) -> DataFrame:
    """Documented score from ratios: speed, volume, regularity and reputation.

    ``metrics`` are velocity metrics. Regularity uses the same falling ratio as
    speed, on the spread of the gaps; an address unknown to ``reputation``
    (column ``reputation_risk`` in [0, 1]) counts as clean.
    """

    def closeness(value: Column) -> Column:
        # greatest() skips NULL, so an unknown spread must be caught first
        near = F.least(F.lit(1.0), F.lit(rules.gap_scale_ms) / F.greatest(value.cast("double"), F.lit(1.0)))
        return F.when(value.isNull(), F.lit(0.0)).otherwise(near)

    speed = closeness(F.col("fastest_click_ms"))
    volume = clamp_unit(F.col("total_clicks").cast("double") / F.lit(rules.volume_scale))
    regularity = closeness(F.col("click_interval_stddev"))
    reputation_risk = F.coalesce(F.col("reputation_risk"), F.lit(0.0))
    return metrics.join(reputation, "ip_address", "left").select(
        "ip_address",
        "total_clicks",
        "fastest_click_ms",
        clamp_unit(
            speed * F.lit(rules.velocity_weight)
            + volume * F.lit(rules.volume_weight)
            + regularity * F.lit(rules.pattern_weight)
            + reputation_risk * F.lit(rules.reputation_weight)
        ).alias("ratio_score"),
    )
