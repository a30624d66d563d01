from __future__ import annotations

import pyarrow as pa

from clicksieve.sources import bid_logs
from clicksieve.streaming import detect, keyed, panes, sinks
from tests.conftest import rows

HOUR = 3_600_000


def _held(query, operator):
    return sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"] if operator in o["operatorName"])


def test_state_does_not_grow_with_the_windows_of_an_event(spark, make_logs, tmp_path):
    """Sixty lone addresses whose hour is over and whose windows are to come: a row of state per window would be over 1,200."""
    lone = [(f"a{i}", i * 1000) for i in range(60)]
    for events in (lone, [("late", 3 * HOUR)]):
        make_logs(events).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    timed = detect.with_event_time(bid_logs.read_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger="1"))
    query = sinks.finish(
        lambda: sinks.to_files(detect.velocity_metrics(timed), str(tmp_path / "out"), str(tmp_path / "cp")), spark, "panes"
    )
    assert 0 < _held(query, "") <= 3 * 60 + 10


def test_keyed_state_is_per_shard_and_stretch(spark, make_logs, tmp_path):
    """Two hundred addresses in ten minutes: a key of each with its timer would be over 400 rows."""
    make_logs([(f"a{i}", i * 1000) for i in range(200)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    timed = detect.with_event_time(bid_logs.read_stream(spark, str(tmp_path / "in")))
    query = sinks.finish(
        lambda: sinks.to_files(keyed.velocity_metrics(timed), str(tmp_path / "out"), str(tmp_path / "cp")), spark, "shards"
    )
    assert 0 < _held(query, "transformWithState") <= 4 * keyed.STRETCH_SHARDS


def test_windows_end_on_the_watermark_once_and_panes_leave_after_their_last_window():
    kept = pa.table({"ip_address": ["a", None, "a"], "at": [10, 10, 12], "order": [0, 0, 0]})
    lists, kept, done = panes._given_out(kept, panes.BEFORE_ALL, 9, per_window=3)
    assert lists is None and kept.num_rows == 3 and done == 9
    lists, kept, done = panes._given_out(kept, done, 12, per_window=3)
    got = sorted(((r.ip_address, r.first, r.last, tuple(r.ats)) for r in lists.itertuples()), key=repr)
    assert got == [("a", 10, 12, (10, 12)), (None, 10, 12, (10,))]
    assert kept.column("at").to_pylist() == [12] and done == 12
    assert panes._given_out(kept, done, 12, per_window=3)[0] is None  # nothing twice
    lists, kept, done = panes._given_out(kept, done, 40, per_window=3)
    assert [(r.first, r.last) for r in lists.itertuples()] == [(13, 14)] and not kept.num_rows


def test_merged_row_is_what_merging_rows_gives(spark, make_logs):
    from pyspark.sql import functions as F

    from clicksieve.operators import fused, suspects

    bot = [("bot", i * 5, {"user_agent": f"u{i % 9}"}) for i in range(1200)]
    fast = [("fast", i * 20) for i in range(5)]
    many = [("many", i * 600_000, {"user_agent": f"u{i}", "country_code": None}) for i in range(7)]
    metrics = fused.detector_metrics(make_logs(bot + fast + many))
    by_rows = suspects.merge_suspects(fused.combined_suspects(metrics))
    sides = metrics.select("ip_address", *[c.alias(n) for n, c in fused.detector_rows().items()])
    merged = suspects.merged_row(F.col("volume"), F.col("velocity"))
    by_columns = sides.where("volume IS NOT NULL OR velocity IS NOT NULL").select("ip_address", *[c.alias(n) for n, c in merged.items()])
    assert by_columns.count() == 3 and rows(by_columns.select(by_rows.columns)) == rows(by_rows)
