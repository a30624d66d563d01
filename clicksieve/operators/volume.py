"""Volume detector: addresses with too many events, agents or campaigns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicksieve.functions.columns import Verdict, flag_list
from clicksieve.rules import DETECTION, DetectionRules

ADDRESS = ("ip_address",)
# Counted columns and the names of their distinct counts.
COUNTED = {"user_agent": "distinct_uas", "campaign_id": "distinct_campaigns", "publisher_id": "distinct_publishers"}


def volume_metrics(logs: DataFrame, keys: Sequence[str] = ADDRESS) -> DataFrame:
    """Event count, three distinct counts and time range per address.

    One scan is grouped four ways at once: by (address, place) and by (address,
    value) for each counted column. That step combines map-side, so a hot
    address is spread over its values, and no task ever holds a set of values;
    ``size(collect_set(...))`` would save an exchange but not survive such an
    address. The second step counts what is left per address and place, the
    third joins the few places. Up to there all buffers are numbers and times:
    a ``min`` of a string any earlier would make Spark sort the rows instead of
    hashing them.
    """
    place, counted, names = ["country_code", "device_type"], list(COUNTED), COUNTED
    sets = [[*keys, *place]] + [[*keys, c] for c in counted]
    per_value = logs.groupingSets(sets, *keys, *place, *counted).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.grouping("country_code").alias("_not_place"),
        *[F.grouping(c).alias(f"_not_{c}") for c in counted],
    )
    # value rows have no place and come together in the row of the NULL place
    per_place = per_value.groupBy(*keys, *place).agg(
        F.sum(F.when(F.col("_not_place") == 0, F.col("_n"))).alias("total_events"),
        *[
            F.count_if((F.col(f"_not_{c}") == 0) & F.col(c).isNotNull()).alias(names[c])
            for c in counted
        ],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return per_place.groupBy(*keys).agg(
        F.sum("total_events").alias("total_events"),
        *[F.sum(name).alias(name) for name in names.values()],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("country_code").alias("country_code"),
        F.min("device_type").alias("device_type"),
    )


def volume_verdict(value: Callable[[str], Column] = F.col, rules: DetectionRules = DETECTION) -> Verdict:
    """Whether metrics are over any entry cut-off, and why.

    Many publishers alone raise a flag but do not make a suspect.
    """
    events, uas = value("total_events"), value("distinct_uas")
    campaigns, publishers = value("distinct_campaigns"), value("distinct_publishers")
    high, rotating, spam = (
        events > rules.high_volume_events,
        uas > rules.rotating_uas,
        campaigns > rules.many_campaigns,
    )
    return Verdict(
        high | rotating | spam,
        flag_list(
            (high, "HIGH_VOLUME"),
            (rotating, "UA_ROTATION"),
            (spam, "CAMPAIGN_SPAM"),
            (publishers > rules.many_publishers, "PUBLISHER_HOPPING"),
        ),
        F.coalesce(
            F.when(events > rules.extreme_volume_events, "EXTREME_HIGH_VOLUME"),
            F.when(high, "HIGH_VOLUME_SUSPECT"),
            F.when(uas > rules.aggressive_uas, "AGGRESSIVE_UA_ROTATION"),
            F.when(rotating, "UA_ROTATION_BOT"),
            F.when(spam, "CAMPAIGN_SPAMMER"),
            F.lit("VOLUME_ANOMALY"),
        ),
    )


def flag_high_volume(metrics: DataFrame, rules: DetectionRules = DETECTION) -> DataFrame:
    """Keep addresses over any entry cut-off and say why."""
    return volume_verdict(rules=rules).kept(metrics)


def high_volume_suspects(
    logs: DataFrame, rules: DetectionRules = DETECTION, keys: Sequence[str] = ADDRESS
) -> DataFrame:
    return flag_high_volume(volume_metrics(logs, keys), rules)


def volume_phase_summary(suspects: DataFrame) -> DataFrame:
    return suspects.agg(
        F.lit("HIGH_VOLUME_FILTER").alias("filter_phase"),
        F.count(F.lit(1)).alias("suspect_count"),
        F.sum("total_events").alias("total_events"),
        F.avg("total_events").alias("avg_events_per_ip"),
        F.count_distinct("fraud_reason").alias("fraud_types"),
    )
