"""Gaps kept per hour against the logs themselves."""

import random

import pytest
from pyspark.sql import functions as F

from clicksieve.operators import hourly, velocity

HOUR_MS = 3_600_000


@pytest.fixture(scope="module")
def logs(make_logs):
    rng = random.Random(3)
    at, events = 0, []
    for _ in range(12_000):  # gaps all over, so that sketches must drop some
        at += int(rng.expovariate(1 / 5000)) + 1
        events.append(("hot", at))
    events += [("few", h * HOUR_MS + m) for h in range(5) for m in (0, 40, 900)] + [("once", 7), ("none", 1), ("none", 90)]
    return make_logs(events).withColumn("ip_address", F.nullif("ip_address", F.lit("none")))


def test_few_gaps_are_exact(logs):
    got = {r.ip_address: r for r in hourly.window_metrics(hourly.hourly_gaps(logs), "2024-01-31").collect()}
    want = {r.ip_address: r for r in velocity.velocity_metrics(logs).collect()}
    assert set(got) == set(want) == {"hot", "few", None}
    for address, r in got.items():
        for name in ("total_clicks", "fastest_click_ms", "ultra_fast_clicks", "avg_click_interval_ms"):
            assert r[name] == want[address][name]
    assert got["few"].median_click_ms == want["few"].median_click_ms and got[None].median_click_ms == 89


def test_rank_of_the_median(logs):
    metrics = hourly.window_metrics(hourly.hourly_gaps(logs), "2024-01-31")
    off = {r.ip_address: r.off for r in hourly.median_rank(metrics, velocity.with_previous_event(logs)).collect()}
    assert set(off) == {"hot", "few"} and off["few"] == 0 and off["hot"] <= hourly.RANK_ERROR


def test_hours_are_kept_by_their_later_event_and_windows_cut_them(logs):
    hours = hourly.hourly_gaps(logs).where("ip_address = 'few'").orderBy(hourly.HOUR).collect()
    assert [(r[hourly.HOUR].hour, r.clicks) for r in hours] == [(0, 2), (1, 3), (2, 3), (3, 3), (4, 3)]
    late = hourly.hourly_gaps(logs, since="2024-01-30 03:00:00").where("ip_address = 'few'").collect()
    assert sorted(r.clicks for r in late) == [3, 3]
    cut = hourly.window_metrics(hourly.hourly_gaps(logs), "2024-01-31 03:00:00").where("ip_address = 'few'").first()
    assert (cut.total_clicks, cut.fastest_click_ms) == (6, 40)


def test_no_logs(logs):
    assert hourly.window_metrics(hourly.hourly_gaps(logs.limit(0)), "2024-01-31").collect() == []
