"""What streams keep, hold at once and write grows with the clock or in bounded parts."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from clicksieve.rules import DETECTION
from clicksieve.sources import bid_logs
from clicksieve.streaming import detect, panes, sinks
from tests.conftest import SF_DIR


def test_a_minute_of_an_address_is_one_row_of_state(spark, make_logs, tmp_path):
    """Three thousand milliseconds of one minute; a row of each would be 3,000."""
    make_logs([("hot", i * 7) for i in range(3000)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    timed = detect.with_event_time(bid_logs.read_stream(spark, str(tmp_path / "in")))
    query = sinks.finish(
        lambda: sinks.to_files(detect.velocity_metrics(timed), str(tmp_path / "out"), str(tmp_path / "cp")), spark, "minute"
    )
    assert 0 < sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) <= 3


def test_panes_are_cut_between_addresses():
    names = ["b", "a", None, "a", "c", "a", "a", "d", None]
    found = list(panes._in_parts(pa.table({"ip_address": names, "at": range(9)}), 3))
    seen = [set(part.column("ip_address").to_pylist()) for part in found]
    assert len(found) > 1 and sum(map(len, seen)) == len(set().union(*seen)) == 5
    assert sorted(i for part in found for i in part.column("at").to_pylist()) == list(range(9))


def test_a_shard_is_given_out_in_parts():
    n = 3 * panes.PART
    kept = pa.table({"ip_address": [f"a{i}" for i in range(n)], "at": np.full(n, 5), "order": np.zeros(n, np.int64)})
    stored = [(panes.packed(kept), panes.BEFORE_ALL)]
    shard = panes._Kept(kept.schema, 24, panes.HOUR_MS, None)
    shard.panes = SimpleNamespace(get=lambda: iter(stored), clear=stored.clear, put=stored.extend)
    timers = []
    shard.handle = SimpleNamespace(registerTimer=timers.append)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 5 * panes.HOUR_MS)
    given = [len(lists) for lists in shard.handleExpiredTimer((0,), clock, None)]
    assert len(given) >= 3 and max(given) <= 2 * panes.PART and sum(given) == n
    # 23 windows of each are to come
    ((rows, done),) = stored
    assert panes.unpacked(rows).num_rows == n and done == 5 and timers == [6 * panes.HOUR_MS - 1]


def _list(*rows):
    """Velocity panes of one list as (start, end, events, fastest, ultra)."""
    return [dict(zip(("start", "end", "events", "fastest", "ultra"), r), of_volume=0) for r in rows]


def test_lists_without_a_suspect_are_told():
    slow = DETECTION.sustained_avg_gap_ms
    lists = [
        _list((0, 0, 1, 0, 0)),  # alone
        _list((0, 0, 1, 0, 0), (slow, slow, 1, 0, 0)),  # no gap short enough for the mean
        _list((0, 0, 1, 0, 0), (slow - 1, slow - 1, 1, 0, 0)),  # a gap between panes
        _list((0, 9, 2, 9, 1)),  # a gap within one
    ]
    table = pa.Table.from_pylist([row for rows in lists for row in rows])
    of = np.repeat(np.arange(len(lists)), [len(rows) for rows in lists])
    assert detect._fast_in(table, of, len(lists), DETECTION).tolist() == [False, False, True, True]
    assert detect._has_gap_in(table, of, len(lists)).tolist() == [False, True, True, True]
    # the events of hours count for volume only
    hours = pa.Table.from_pylist([{**_list((0, 0, n, 0, 0))[0], "of_volume": 1} for n in (5, 6)])
    both, of = pa.concat_tables([table, hours]), np.append(of, [0, 1])
    order = np.argsort(of, kind="stable")
    told = detect._suspect_in(both.take(pa.array(order)), of[order], len(lists), DETECTION)
    assert told.tolist() == [False, True, True, True]


def test_json_lines_are_stored_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(entry, "work_folder", lambda session, purpose: str(tmp_path / purpose))
    monkeypatch.setattr(entry, "ROWS_PER_JSON_FILE", 200)
    read = sum(r.lines for r in entry._json_stream_ingest(entry.configure(spark), SF_DIR).collect())
    logs = entry._logs(spark, SF_DIR)
    files = list((tmp_path / "json-stream" / "lines").glob("part-*"))
    assert read == logs.count() and len(files) == -(-read // 200) > entry.JSON_FILES and {f.suffix for f in files} == {".gz"}
    assert sum(f.stat().st_size for f in files) < read * 100
