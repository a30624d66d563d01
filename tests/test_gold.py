"""The kept alert table: days filled once, status changes, clean-up."""

from __future__ import annotations

from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clicksieve.operators import alerts
from clicksieve.plans import gold, jobs
from clicksieve.rules import BLOCK, DISMISSED, ESCALATED, EXECUTED, PENDING, REVIEW
from clicksieve.sources import bid_logs
from tests.conftest import START, rows

DAY_MS = 86_400_000
DAYS = [date(2024, 1, 30) + timedelta(days=i) for i in range(12)]


def events_of(day):
    """One address to block, one to review, and quiet ones; none on the third day."""
    if day == 2:
        return [("quiet", 2 * DAY_MS + 1)]
    fast = [("block", day * DAY_MS + i * 5, {"user_agent": f"u{i % 30}"}) for i in range(1200)]
    slow = [("review", day * DAY_MS + i * 60_000, {"user_agent": f"u{i}"}) for i in range(7)]
    return fast + slow + [("quiet", day * DAY_MS + 5)]


@pytest.fixture
def layout(make_logs, tmp_path):
    folder = str(tmp_path / "logs")
    for day in range(3):
        bid_logs.write_layout(make_logs(events_of(day)), folder, files=2, mode="append")
    return folder


def files_of(store, day):
    return {(p.name, p.stat().st_mtime_ns) for p in Path(store.alerts_path, f"event_day={day}").glob("*.parquet")}




def test_a_second_run_reads_the_new_day_only(spark, make_logs, layout, tmp_path, monkeypatch):
    store = gold.AlertStore(spark, str(tmp_path / "store"))
    assert store.processed() == set() and store.backfill(layout) == DAYS[:3]
    before = {d: files_of(store, d) for d in DAYS[:3]}
    assert {r.event_day for r in store.stored().collect()} == set(DAYS[:2])
    assert before[DAYS[0]] and not before[DAYS[2]]  # a day without alerts is processed as well
    assert store.backfill(layout) == []
    bid_logs.write_layout(make_logs(events_of(3)), layout, files=2, mode="append")
    seen = []

    def history(logs, rules):
        seen.append({r[0] for r in logs.select(F.to_date("timestamp")).distinct().collect()})
        seen.append({r[0].split("event_date=")[1][:10] for r in logs.select(F.input_file_name()).distinct().collect()})
        return jobs.alert_history(logs, rules)

    monkeypatch.setattr(gold, "alert_history", history)
    assert store.backfill(layout) == [DAYS[3]]
    assert seen == [{DAYS[3]}, {str(DAYS[3])}]
    assert {d: files_of(store, d) for d in DAYS[:3]} == before and files_of(store, DAYS[3])
    whole = jobs.alert_history(spark.read.parquet(layout).drop("event_date"))
    assert rows(store.stored().select(*whole.columns)) == rows(whole)


def test_a_day_is_done_anew(spark, make_logs, layout, tmp_path):
    store = gold.AlertStore(spark, str(tmp_path / "store"))
    store.backfill(layout)
    kept = files_of(store, DAYS[1])
    corrected = make_logs([("quiet", 1)])
    tmp = str(tmp_path / "corrected")
    bid_logs.write_layout(corrected, tmp, files=1)
    assert store.backfill(tmp, again={DAYS[0], DAYS[9]}) == [DAYS[0]]  # a day that is not there is not made up
    assert {r.event_day for r in store.stored().collect()} == {DAYS[1]} and files_of(store, DAYS[1]) == kept


def test_changes_are_recorded_shown_and_folded(spark, layout, tmp_path):
    store = gold.AlertStore(spark, str(tmp_path / "store"))
    store.backfill(layout)
    blocks = F.col("final_action") == BLOCK
    plain = alerts.execute_all_blocks(store.stored(), "auto", START)
    for _ in range(2):  # the same change again
        assert store.change("a", blocks, EXECUTED, "auto", START) == 2
    assert rows(store.current()) == rows(plain)
    assert store.change("b", blocks, ESCALATED, "x", START) == 0  # no longer open
    first_day = F.col("event_day") == DAYS[0]
    assert store.change("c", first_day, ESCALATED, "analyst", START + timedelta(hours=1), only_from=(PENDING, EXECUTED)) == 2
    assert {(r.ip_address, r.action_status) for r in store.stored().collect()} == {("block", PENDING), ("review", PENDING)}
    want = rows(store.current())
    assert {r.action_status for r in store.current().where(first_day).collect()} == {ESCALATED}
    assert store.fold() == DAYS[:2] and rows(store.stored()) == want == rows(store.current()) and store.fold() == []
    other = files_of(store, DAYS[1])
    store.change("d", first_day & (F.col("final_action") == REVIEW), DISMISSED, "y", START + timedelta(hours=2), only_from=(ESCALATED,))
    assert store.fold() == [DAYS[0]] and files_of(store, DAYS[1]) == other
    assert store.stored().where(first_day & (F.col("action_status") == DISMISSED)).count() == 1


def test_null_conditions_change_nothing(spark, layout, tmp_path):
    store = gold.AlertStore(spark, str(tmp_path / "store"))
    store.backfill(layout)
    assert store.change("n", F.lit(None).cast("boolean"), EXECUTED, "x", START) == 0 and store.fold() == []


def test_expired_days_go_and_others_keep_their_files(spark, make_logs, layout, tmp_path):
    for day in (9, 10, 11):
        bid_logs.write_layout(make_logs(events_of(day)), layout, files=2, mode="append")
    store = gold.AlertStore(spark, str(tmp_path / "store"))
    store.backfill(layout)
    kept = {d: files_of(store, d) for d in (DAYS[10], DAYS[11])}
    as_of = START + timedelta(days=12, hours=12)
    want = rows(alerts.unexpired(store.stored(), as_of))
    # three days after their creation reviews are over, and seven days after it blocks
    assert store.expire(as_of) == (DAYS[:2], [DAYS[9]])
    assert rows(store.stored()) == want and {d: files_of(store, d) for d in kept} == kept
    assert {(r.event_day, r.ip_address) for r in store.stored().where(F.col("event_day") == DAYS[9]).collect()} == {(DAYS[9], "block")}
    assert store.expire(as_of) == ([], [])
    everything = START + timedelta(days=90)
    assert store.expire(everything)[0] == DAYS[9:] and store.backfill(layout) == []
    assert store.stored().count() == store.current().count() == 0 and store.expire(everything) == ([], [])
