"""Slices cut by load give the same rows, whatever one address sends within a slice."""

import random

import pytest
from pyspark.sql import functions as F

from clicksieve.operators import fused, load_slices, velocity
from tests.conftest import rows

PART = velocity.stored_slice()


def loads(df):
    return {tuple(r)[:2]: r.n for r in df.groupBy("ip_address", PART).agg(F.count(F.lit(1)).alias("n")).collect()}


@pytest.fixture(scope="module")
def logs(make_logs):
    draw = random.Random(4)
    events = [("burst", 600_000 + draw.randrange(900), {"user_agent": f"u{i % 5}"}) for i in range(1500)]
    events += [("burst", draw.randrange(86_400_000)) for _ in range(200)]
    events += [("none", 60_000 + draw.randrange(50_000)) for _ in range(400)]
    events += [(f"a{i % 9}", draw.randrange(86_400_000)) for i in range(300)]
    return make_logs(events).withColumn("ip_address", F.nullif("ip_address", F.lit("none")))


@pytest.mark.parametrize("rows_per_part", [1, 50, 10_000])
def test_same_rows(logs, rows_per_part):
    cut = load_slices.with_load_slices(logs, rows_per_part=rows_per_part)
    assert rows(cut.select(*logs.columns)) == rows(logs)
    for metrics in (velocity.velocity_metrics, fused.detector_metrics):
        assert rows(metrics(cut)) == rows(metrics(logs))
    times = ("bid_request_id", "prev_timestamp")
    assert rows(velocity.with_previous_event(cut).select(*times)) == rows(velocity.with_previous_event(logs).select(*times))


def test_a_burst_is_cut_where_its_events_lie(logs):
    """A second holds the burst, so parts of equal length would leave it whole."""
    cut = loads(load_slices.with_load_slices(logs, rows_per_part=100))
    burst = [n for (ip, at), n in cut.items() if ip == "burst" and n > 20]
    assert len(burst) >= 15 and max(burst) <= 115
    null = [n for (ip, at), n in cut.items() if ip is None]
    assert sum(null) == 400 and len(null) == 4


def test_other_slices_are_left_alone(logs):
    cut = loads(load_slices.with_load_slices(logs, rows_per_part=10_000))
    plain = {(r.ip_address, r.s * 60_000) for r in logs.select("ip_address", velocity.time_slice().alias("s")).distinct().collect()}
    assert cut.keys() == plain


def test_one_millisecond_stays_together(make_logs):
    cut = load_slices.with_load_slices(make_logs([("a", 7)] * 30 + [("a", 8)]), rows_per_part=10)
    assert sorted(loads(cut).values()) == [1, 30]
    assert velocity.velocity_metrics(cut).first().total_clicks == 30


def test_stored_slices_are_replaced_and_empty_logs_have_none(logs):
    twice = load_slices.with_load_slices(load_slices.with_load_slices(logs, rows_per_part=50), rows_per_part=100)
    assert twice.columns == [*logs.columns, PART]
    assert loads(twice) == loads(load_slices.with_load_slices(logs, rows_per_part=100))
    assert load_slices.with_load_slices(logs.limit(0)).collect() == []


def test_parts_grow_with_the_input():
    assert load_slices.part_size(10**9) == 10**6
    assert load_slices.part_size(10**13) == 10**8


def test_five_million_events_of_one_minute(spark, make_logs):
    """One address, one minute: no task sorts more than a part, and the metrics are those of the whole."""
    one = make_logs([("hot", 0)])
    at = F.lit(one.first().timestamp) + F.expr("make_interval(0, 0, 0, 0, 0, 0, cast(id * 12 as decimal(18,6)) / 1000000)")
    logs = spark.range(5_000_000).select(
        *[(at if f.name == "timestamp" else F.lit(one.first()[f.name])).cast(f.dataType).alias(f.name) for f in one.schema]
    )
    cut = load_slices.with_load_slices(logs, rows_per_part=400_000)
    found = loads(cut)
    assert len(found) == 13 and max(found.values()) <= 400_100
    row = velocity.velocity_metrics(cut).first()
    assert (row.total_clicks, row.fastest_click_ms, row.ultra_fast_clicks) == (4_999_999, 0, 4_999_999)
    assert row.avg_click_interval_ms == pytest.approx(59_999 / 4_999_999) and row.median_click_ms == 0
    tasks = cut.repartition(16, PART, "ip_address").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 6
