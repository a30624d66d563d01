from __future__ import annotations

import random
import statistics
from datetime import timedelta

import pytest

from clicksieve.operators import velocity
from tests.conftest import START, rows


def brute_force(events):
    """Metrics from sorted times per address, one address at a time."""
    by_ip = {}
    for ip, at, *_ in events:
        by_ip.setdefault(ip, []).append(at)
    out = {}
    for ip, times in by_ip.items():
        times.sort()
        gaps = [int(b // 1) - int(a // 1) for a, b in zip(times, times[1:])]
        if gaps:
            out[ip] = (
                len(gaps), min(gaps), sum(gaps) / len(gaps), statistics.median(gaps),
                statistics.stdev(gaps) if len(gaps) > 1 else None,
                sum(g < 50 for g in gaps), sum(g < 100 for g in gaps), times[1], times[-1],
            )
    return out


def check(make_logs, events, slice_seconds):
    expected = brute_force(events)
    got = {r.ip_address: r for r in velocity.velocity_metrics(make_logs(events), slice_seconds=slice_seconds).collect()}
    assert got.keys() == expected.keys()
    for ip, want in expected.items():
        row = got[ip]
        assert (row.total_clicks, row.fastest_click_ms) == want[:2]
        assert row.avg_click_interval_ms == pytest.approx(want[2])
        assert row.median_click_ms == want[3]
        assert row.click_interval_stddev == (None if want[4] is None else pytest.approx(want[4]))
        assert (row.ultra_fast_clicks, row.very_fast_clicks) == want[5:7]
        assert (row.first_seen, row.last_seen) == tuple(START + timedelta(milliseconds=t) for t in want[7:])


@pytest.mark.parametrize("slice_seconds", [1, 60, 3600, 86400])
@pytest.mark.parametrize("seed", [1, 2])
def test_slices_give_the_same_as_whole_addresses(make_logs, seed, slice_seconds):
    draw = random.Random(seed)
    events = [("hot", draw.randrange(0, 600_000)) for _ in range(800)]  # many ties
    events += [(f"ip{draw.randrange(20)}", draw.randrange(0, 86_400_000)) for _ in range(200)]
    check(make_logs, events, slice_seconds)


def test_hot_burst_in_one_slice(make_logs):
    check(make_logs, [("hot", i // 5) for i in range(2000)] + [("cold", 5)], 60)


def test_single_event_has_no_row(make_logs):
    assert velocity.velocity_metrics(make_logs([("a", 5)])).collect() == []


def test_same_millisecond_is_a_gap_of_zero(make_logs):
    row = velocity.velocity_metrics(make_logs([("a", 5), ("a", 5)])).first()
    assert (row.total_clicks, row.fastest_click_ms, row.median_click_ms) == (1, 0, 0.0)
    assert row.click_interval_stddev is None


def test_gap_counts_millisecond_boundaries(make_logs):
    row = velocity.velocity_metrics(make_logs([("a", 0.9), ("a", 1.1)])).first()
    assert row.fastest_click_ms == 1


def test_place_of_the_first_event_is_left_out(make_logs):
    row = velocity.velocity_metrics(make_logs([("a", 1, {"country_code": "AA"}), ("a", 2, {"country_code": "ZZ"})])).first()
    assert row.country_code == "ZZ"


@pytest.mark.parametrize("slice_seconds", [1, 60, 86400])
def test_previous_event_per_row(make_logs, slice_seconds):
    draw = random.Random(3)
    events = [(f"ip{draw.randrange(5)}", draw.randrange(0, 400_000)) for _ in range(400)]
    logs = make_logs(events).select("bid_request_id", "timestamp", "ip_address")
    expected = []
    for ip in {e[0] for e in events}:
        mine = sorted((at, f"r{n}") for n, (who, at) in enumerate(events) if who == ip)
        before = [None] + [at for at, _ in mine][:-1]
        expected += [
            (rid, START + timedelta(milliseconds=at), ip, None if p is None else START + timedelta(milliseconds=p),
             None if p is None else at - p)
            for (at, rid), p in zip(mine, before)
        ]
    assert rows(velocity.with_previous_event(logs, slice_seconds=slice_seconds)) == sorted(expected, key=repr)


def test_previous_event_keeps_rows_without_address_and_joins_nothing(spark):
    events = [("r0", START, None), ("r1", START + timedelta(seconds=70), None), ("r2", START, "a")]
    logs = spark.createDataFrame(events, "bid_request_id string, timestamp timestamp_ntz, ip_address string")
    found = velocity.with_previous_event(logs)
    assert [(r.bid_request_id, r.time_diff_ms) for r in found.orderBy("bid_request_id").collect()] == [("r0", None), ("r1", 70_000), ("r2", None)]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def metrics(spark, fastest, ultra=0, average=5000.0):
    return spark.createDataFrame(
        [("a", fastest, ultra, average)],
        "ip_address string, fastest_click_ms bigint, ultra_fast_clicks bigint, avg_click_interval_ms double",
    )


@pytest.mark.parametrize(
    "values, reason, flags",
    [
        ((9,), "INHUMAN_VELOCITY_BOT", ["INHUMAN_SPEED", "BOT_LIKE_SPEED", "SUSPICIOUS_SPEED"]),
        ((10,), "HIGH_VELOCITY_BOT", ["BOT_LIKE_SPEED", "SUSPICIOUS_SPEED"]),
        ((49,), "HIGH_VELOCITY_BOT", ["BOT_LIKE_SPEED", "SUSPICIOUS_SPEED"]),
        ((50,), "SUSPICIOUS_VELOCITY", ["SUSPICIOUS_SPEED"]),
        ((99,), "SUSPICIOUS_VELOCITY", ["SUSPICIOUS_SPEED"]),
        ((100,), None, None),
        ((100, 0, 199.0), "VELOCITY_ANOMALY", ["CONSISTENTLY_FAST"]),
        ((100, 0, 200.0), None, None),
        ((100, 100), None, None),
        ((100, 101), "REPEATED_FAST_PATTERN", ["REPEATED_ULTRA_FAST"]),
    ],
)
def test_cut_offs(spark, values, reason, flags):
    found = velocity.flag_high_velocity(metrics(spark, *values)).collect()
    if reason is None:
        assert found == []
    else:
        assert (found[0].fraud_reason, found[0].fraud_flags) == (reason, flags)
