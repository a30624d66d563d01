from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clicksieve.operators import fused, scoring, suspects, velocity, volume
from clicksieve.rules import SCORING
from tests.conftest import rows

AS_OF = "2024-01-31 00:00:00"


def test_address_caught_by_both_detectors(make_logs):
    logs = make_logs([("both", i * 20, {"user_agent": f"u{i % 8}"}) for i in range(1200)] + [("quiet", 1), ("quiet", 90_000)])
    found = fused.suspect_ips(logs, AS_OF).collect()
    assert [r.ip_address for r in found] == ["both"]
    row = found[0]
    assert (row.total_clicks, row.events_total) == (1200 + 1199, 1200)
    assert row.fraud_reasons == ["HIGH_VELOCITY_BOT", "HIGH_VOLUME_SUSPECT"]
    assert row.detection_methods == ["HIGH_VELOCITY", "HIGH_VOLUME"]
    assert row.primary_fraud_reason == "HIGH_VELOCITY_BOT"
    assert row.fraud_flags == sorted(
        ["HIGH_VOLUME", "UA_ROTATION", "BOT_LIKE_SPEED", "SUSPICIOUS_SPEED", "REPEATED_ULTRA_FAST", "CONSISTENTLY_FAST"]
    )


@pytest.mark.parametrize("slice_seconds", [1, 60, 3600])
def test_one_scan_gives_what_the_detectors_give_apart(make_logs, slice_seconds):
    """A hot address with many values, values that come back, missing values and addresses, single events."""
    hot = [("hot", i * 37 % 90_000, {"user_agent": f"u{i % 5 // 2}", "campaign_id": f"c{i}", "publisher_id": None}) for i in range(2000)]
    mixed = [(f"a{i % 9}", i * i * 911 % 5_000_000, {"user_agent": [None, "x", "y"][i % 3], "country_code": "UDC"[i % 3]}) for i in range(300)]
    logs = make_logs(hot + mixed + [("single", 7), ("none", 1), ("none", 5), ("none", 5), ("same", 3), ("same", 3)])
    logs = logs.withColumn("ip_address", F.nullif("ip_address", F.lit("none")))
    metrics = fused.detector_metrics(logs, slice_seconds=slice_seconds)
    apart = {"volume": volume.volume_metrics(logs), "velocity": velocity.velocity_metrics(logs)}
    together = {"volume": fused.volume_metrics(metrics), "velocity": fused.velocity_metrics(metrics)}
    for name, df in apart.items():
        assert together[name].columns == df.columns and rows(together[name]) == rows(df)
    merged = suspects.merge_suspects(
        suspects.combine_detectors(volume.flag_high_volume(apart["volume"]), velocity.flag_high_velocity(apart["velocity"]))
    )
    assert rows(fused.suspect_ips(logs, AS_OF)) == rows(suspects.finish_suspects(merged, AS_OF)) and merged.count() > 1


def test_volume_only_suspect_shows_no_gaps(make_logs):
    logs = make_logs([("a", i * 60_000, {"user_agent": f"u{i}"}) for i in range(6)])
    row = fused.suspect_ips(logs, AS_OF).first()
    assert (row.fastest_click_ms, row.avg_click_interval_ms, row.distinct_uas) == (None, None, 6)


def test_velocity_only_suspect_shows_no_agents(make_logs):
    row = fused.suspect_ips(make_logs([("a", 0), ("a", 60)]), AS_OF).first()
    assert (row.distinct_uas, row.fastest_click_ms, row.total_clicks, row.events_total) == (None, 60, 1, 2)


@pytest.mark.parametrize(
    "reasons, primary",
    [
        (["EXTREME_HIGH_VOLUME", "INHUMAN_VELOCITY_BOT"], "INHUMAN_VELOCITY_BOT"),
        (["EXTREME_HIGH_VOLUME", "HIGH_VELOCITY_BOT"], "HIGH_VELOCITY_BOT"),
        (["EXTREME_HIGH_VOLUME", "SUSPICIOUS_VELOCITY"], "EXTREME_HIGH_VOLUME"),
        (["SUSPICIOUS_VELOCITY", "UA_ROTATION_BOT"], "UA_ROTATION_BOT"),
        (["AGGRESSIVE_UA_ROTATION", "SUSPICIOUS_VELOCITY"], "AGGRESSIVE_UA_ROTATION"),
        ([], None),
    ],
)
def test_primary_reason(spark, reasons, primary):
    df = spark.createDataFrame([(reasons,)], "reasons array<string>")
    assert df.select(suspects.primary_reason(F.col("reasons"))).first()[0] == primary


def test_summary_and_top(make_logs):
    logs = make_logs([(ip, i * 60_000, {"user_agent": f"u{i}"}) for ip, n in (("a", 6), ("b", 8), ("c", 8)) for i in range(n)])
    found = fused.suspect_ips(logs, AS_OF)
    assert [r.ip_address for r in suspects.top_suspects(found, 2).collect()] == ["b", "c"]
    summary = suspects.filtering_summary(found).first()
    assert (summary.total_suspects, summary.total_suspicious_clicks, summary.affected_countries) == (3, 22, 1)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_base_scores(spark):
    for name, expected in [*SCORING.base_scores, ("REPEATED_FAST_PATTERN", 0.35), (None, 0.35)]:
        assert value(spark, scoring.base_score(F.lit(name).cast("string"))) == expected


@pytest.mark.parametrize(
    "build, cases",
    [
        (scoring.velocity_score, [(None, 0.2), (0, 1.0), (9, 1.0), (10, 0.9), (49, 0.9), (50, 0.7), (99, 0.7), (100, 0.5), (199, 0.5), (200, 0.3)]),
        (scoring.volume_score, [(99, 0.25), (100, 0.4), (499, 0.4), (500, 0.55), (999, 0.55), (1000, 0.7), (4999, 0.7), (5000, 0.85), (9999, 0.85), (10000, 1.0)]),
        (scoring.ua_rotation_score, [(None, 0.1), (2, 0.2), (3, 0.5), (4, 0.5), (5, 0.7), (9, 0.7), (10, 0.85), (19, 0.85), (20, 1.0)]),
        (scoring.risk_level, [(0.39, "LOW"), (0.4, "MEDIUM"), (0.69, "MEDIUM"), (0.7, "HIGH"), (0.89, "HIGH"), (0.9, "CRITICAL")]),
    ],
)
def test_tiers(spark, build, cases):
    kind = "double" if build is scoring.risk_level else "bigint"
    for given, expected in cases:
        assert value(spark, build(F.lit(given).cast(kind))) == expected


def test_weights_are_added_in_double_from_the_left(spark):
    parts = [(0.7, 0.5, 1.0, 0.7), (0.7, 0.2, 0.25, 0.1), (0.98, 1.0, 1.0, 1.0), (0.35, 0.2, 0.25, 0.1)]
    df = spark.createDataFrame(parts, "b double, v double, n double, u double")
    got = [r[0] for r in df.select(scoring.weighted_score(*(F.col(c) for c in "bvnu"))).collect()]
    assert got == [b * 0.40 + v * 0.30 + n * 0.20 + u * 0.10 for b, v, n, u in parts]
    assert got[0] < 0.7  # decimal arithmetic would reach the cut-off


def test_score_stays_in_unit_interval(spark):
    assert value(spark, scoring.clamp_unit(F.lit(1.7))) == 1.0
    assert value(spark, scoring.clamp_unit(F.lit(-0.2))) == 0.0
    assert value(spark, scoring.clamp_unit(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize(
    "fastest, uas, clicks, expected",
    [(5, 3, 1000, 0.95), (5, 3, 999, 0.75), (5, None, 5000, 0.75), (None, 3, 5000, 0.75), (None, None, 5000, 0.5)],
)
def test_confidence(spark, fastest, uas, clicks, expected):
    args = (F.lit(v).cast("bigint") for v in (fastest, uas, clicks))
    assert value(spark, scoring.confidence(*args)) == expected


def test_score_table_columns(make_logs):
    from clicksieve.schemas import FINAL_RISK_SCORES

    scored = scoring.risk_scores(fused.suspect_ips(make_logs([("a", 0), ("a", 5)]), AS_OF), AS_OF)
    assert scored.dtypes == [(f.name, f.dataType.simpleString()) for f in FINAL_RISK_SCORES.fields]
    row = scored.first()
    assert row.risk_score == 0.98 * 0.4 + 1.0 * 0.3 + 0.25 * 0.2 + 0.1 * 0.1
    assert (row.risk_level, row.fraud_flag, row.confidence_level) == ("HIGH", True, 0.75)


def test_signal_weights(spark):
    found = spark.createDataFrame(
        [("a", ["HIGH_VELOCITY_BOT", "UA_ROTATION_BOT"], "CN"), ("b", [], "US"),
         ("c", ["HIGH_VELOCITY_BOT", "UA_ROTATION_BOT", "EXTREME_HIGH_VOLUME", "HIGH_VOLUME_SUSPECT"], "US")],
        "ip_address string, fraud_reasons array<string>, country_code string",
    )
    devices = spark.createDataFrame([("a", 3), ("c", 1)], "ip_address string, distinct_devices bigint")
    got = {r.ip_address: (round(r.signal_score, 9), r.signal_level) for r in
           scoring.signal_weight_score(found, devices, ("CN",)).collect()}
    assert got == {"a": (0.85, "HIGH"), "b": (0.0, "LOW"), "c": (1.0, "CRITICAL")}


def test_ratio_score(spark):
    metrics = spark.createDataFrame(
        [("a", 10_000, 0, 50.0), ("b", 2500, 200, 400.0), ("c", 0, 1000, None)],
        "ip_address string, total_clicks bigint, fastest_click_ms bigint, click_interval_stddev double",
    )
    reputation = spark.createDataFrame([("a", 1.0)], "ip_address string, reputation_risk double")
    got = {r.ip_address: r.ratio_score for r in scoring.ratio_score(metrics, reputation).collect()}
    assert got["a"] == pytest.approx(1.0)
    assert got["b"] == pytest.approx(0.4 * 0.5 + 0.3 * 0.5 + 0.2 * 0.25)
    assert got["c"] == pytest.approx(0.4 * 0.1)
