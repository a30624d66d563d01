from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clicksieve.functions import udfs
from clicksieve.operators import alerts
from clicksieve.rules import ACTIONS, STRICT_ACTIONS

NAN = float("nan")
AS_OF = datetime(2024, 1, 31)
SCORES = [None, NAN, 0.0, 0.39, 0.40, 0.59, 0.60, 0.61, 0.69, 0.70, 0.85, 0.86, 0.89, 0.90, 0.94, 0.95, 1.0]
SURE = [None, 0.5, 0.7, 0.71, 0.79, 0.80, 0.9, 0.91, 1.0]


def expected_action(score, sure):
    if score is None:
        return "ERROR_MISSING_SCORE"
    sure = 0.5 if sure is None else sure
    if score >= 0.9 or (score >= 0.7 and sure >= 0.8):
        return "BLOCK_IP_IMMEDIATELY"
    return "SEND_TO_MANUAL_REVIEW" if score >= 0.4 else "MONITOR_PASSIVELY"


def expected_strict(score, sure):
    if score is None:
        return "ERROR_MISSING_SCORE"
    sure = 0.5 if sure is None else sure
    if score > 0.85 and sure > 0.9:
        return "BLOCK_IP_IMMEDIATELY"
    return "SEND_TO_MANUAL_REVIEW" if score > 0.6 and sure > 0.7 else "MONITOR_PASSIVELY"


@pytest.fixture(scope="module")
def grid(spark):
    pairs = [(s, c) for s in SCORES for c in SURE]
    return spark.createDataFrame(pairs, "risk_score double, confidence_level double")


@pytest.mark.parametrize(
    "rules, function, expected",
    [(ACTIONS, udfs.DECISION_FUNCTION, expected_action), (STRICT_ACTIONS, udfs.STRICT_FUNCTION, expected_strict)],
)
def test_actions_in_columns_and_in_sql_functions(spark, grid, rules, function, expected):
    udfs.register(spark)
    got = grid.select(
        "*",
        alerts.classify_action(F.col("risk_score"), F.col("confidence_level"), rules).alias("native"),
        F.expr(f"{function}(risk_score, confidence_level)").alias("udf"),
    ).collect()
    assert len(got) == len(SCORES) * len(SURE)
    for row in got:
        assert row.native == expected(row.risk_score, row.confidence_level), row
        assert row.udf == row.native, row


def test_priorities(spark):
    cases = [
        (0.95, "BLOCK_IP_IMMEDIATELY", "CRITICAL"), (0.94, "BLOCK_IP_IMMEDIATELY", "HIGH"),
        (0.60, "SEND_TO_MANUAL_REVIEW", "MEDIUM"), (0.59, "SEND_TO_MANUAL_REVIEW", "LOW"),
        (0.99, "MONITOR_PASSIVELY", "LOW"), (None, "ERROR_MISSING_SCORE", "LOW"),
    ]
    df = spark.createDataFrame(cases, "score double, action string, expected string")
    got = df.select(alerts.alert_priority(F.col("score"), F.col("action")).alias("p"), "expected").collect()
    assert all(r.p == r.expected for r in got)


@pytest.mark.parametrize(
    "score, reasons, clicks, fastest, country, text",
    [
        (0.932, ["A", "B", "C", "D"], 12345, 6, "US", "Critical risk (0.93) | Flags: A, B, C | 12,345 clicks | Ultra-fast clicks (6ms) | Country: US"),
        (0.7, [], 999, 100, "DE", "High risk (0.70) | 999 clicks | Country: DE"),
        (0.5, None, 0, 0, "", "Standard risk profile"),
        (0.5, None, None, None, None, "Standard risk profile"),
        (0.5, ["A"], 0, 99, None, "Flags: A | Ultra-fast clicks (99ms)"),
    ],
)
def test_evidence(spark, score, reasons, clicks, fastest, country, text):
    df = spark.createDataFrame(
        [(score, reasons, clicks, fastest, country)],
        "s double, r array<string>, n bigint, f bigint, c string",
    )
    assert df.select(alerts.evidence_summary(*(F.col(c) for c in "srnfc"))).first()[0] == text


def test_simple_evidence(spark):
    df = spark.createDataFrame([(0.95, "US", 10), (0.75, None, 10), (0.1, "DE", 3)], "s double, c string, n bigint")
    got = [r[0] for r in df.select(alerts.simple_evidence(F.col("s"), F.col("c"), F.col("n"))).collect()]
    assert got == ["Critical risk (0.95) | US | 10", "High risk (0.75) | 10", "Standard risk | DE | 3"]


def scored(spark, *rows):
    return spark.createDataFrame(
        [(ip, s, "HIGH", 0.95, "US", 1500, 5, ["R"]) for ip, s in rows],
        "ip_address string, risk_score double, risk_level string, confidence_level double, country_code string,"
        " total_clicks bigint, fastest_click_ms bigint, fraud_reasons array<string>",
    )


@pytest.fixture(scope="module")
def table(spark):
    return alerts.actionable_alerts(scored(spark, ("1.2.3.4", 0.96), ("1.2.3.5", 0.5), ("1.2.3.6", 0.1)), AS_OF)


def test_alert_table(table):
    from clicksieve.schemas import ACTIONABLE_ALERTS

    assert table.dtypes == [(f.name, f.dataType.simpleString()) for f in ACTIONABLE_ALERTS.fields]
    block, review, watch = table.orderBy("ip_address").collect()
    assert block.alert_id == "ALERT-1.2.3.4-20240131000000"
    assert (block.final_action, block.priority, block.action_status) == ("BLOCK_IP_IMMEDIATELY", "CRITICAL", "PENDING")
    assert [r.expires_at.day for r in (block, review, watch)] == [7, 3, 1]
    assert all(r.created_at == AS_OF and r.actioned_by is None for r in (block, review, watch))


def test_summaries(table):
    assert {tuple(r)[:2] for r in alerts.action_summary(table).collect()} == {
        ("BLOCK_IP_IMMEDIATELY", 1), ("SEND_TO_MANUAL_REVIEW", 1), ("MONITOR_PASSIVELY", 1),
    }
    assert {tuple(r) for r in alerts.priority_summary(table).collect()} == {("CRITICAL", 1), ("LOW", 2)}
    assert tuple(alerts.action_required(table).first()) == (1, 1)


def test_status_updates_touch_open_matches_only(table):
    done = alerts.execute_all_blocks(table, "auto", AS_OF)
    done = alerts.dismiss(done, F.lit(True), "ann", AS_OF)
    done = alerts.escalate(done, F.lit(True), "bob", AS_OF)
    got = {r.ip_address: (r.action_status, r.actioned_by) for r in done.collect()}
    assert got == {"1.2.3.4": ("EXECUTED", "auto"), "1.2.3.5": ("DISMISSED", "ann"), "1.2.3.6": ("DISMISSED", "ann")}


def test_null_match_changes_nothing(table):
    done = alerts.dismiss(table, F.lit(None).cast("boolean"), "x", AS_OF)
    assert {r.action_status for r in done.collect()} == {"PENDING"}


def test_unexpired(table):
    kept = alerts.unexpired(table, datetime(2024, 2, 2)).collect()
    assert {r.ip_address for r in kept} == {"1.2.3.4", "1.2.3.5"}


def test_masks(spark):
    df = spark.createDataFrame([("10.0.0.7",), ("2001:db8::7",)], "ip_address string")
    assert {r[0] for r in alerts.mask_addresses(df).collect()} == {"10.0.0.xxx", "2001:db8::xxx"}
    digests = [r[0] for r in alerts.mask_addresses(df, salt="s").collect()]
    assert all(len(d) == 64 for d in digests) and digests[0] != digests[1]


def test_optional_filters(table):
    assert alerts.filtered(table).count() == 3
    assert alerts.filtered(table, priority="All", final_action=None).count() == 3
    assert alerts.filtered(table, priority="LOW", action_status="PENDING").count() == 2
    assert alerts.in_selection(table, "2024-01-31", "2024-01-31").count() == 2
    assert alerts.in_selection(table, "2024-02-01", "2024-02-09").count() == 0
