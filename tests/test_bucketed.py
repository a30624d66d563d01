"""The bucketed table feeds the detectors without an exchange of raw rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from clicksieve.operators import fused, velocity
from clicksieve.sources import bid_logs, bucketed
from tests.conftest import rows
from tests.test_plans import exchanges


@pytest.fixture(scope="module")
def logs(make_logs):
    events = [("hot", i * 37, {"user_agent": f"u{i % 9}"}) for i in range(4000)]
    events += [(f"a{i % 7}", i * 9000, {"campaign_id": f"c{i % 3}"}) for i in range(300)] + [("none", 5), ("none", 70_000)]
    return make_logs(events).withColumn("ip_address", F.nullif("ip_address", F.lit("none")))


@pytest.fixture(scope="module")
def stored(spark, logs, tmp_path_factory):
    name = f"logs_{uuid.uuid4().hex}"
    yield bucketed.write_bucketed(logs, name, 4, path=str(tmp_path_factory.mktemp("bucketed")))
    spark.sql(f"DROP TABLE {name}")


def test_no_exchange_of_raw_rows(stored):
    recent = bid_logs.trailing_window(stored, "2024-01-31")
    for metrics in (velocity.velocity_metrics(recent), fused.detector_metrics(recent)):
        found = exchanges(metrics)
        assert found and not any("slice" in e for e in found)


def test_other_slices_still_exchange(stored):
    assert any("slice" in e for e in exchanges(velocity.velocity_metrics(stored, slice_seconds=30)))


def test_same_rows(logs, stored):
    assert rows(stored.select(*logs.columns)) == rows(logs)
    for metrics in (velocity.velocity_metrics, fused.detector_metrics):
        assert rows(metrics(stored)) == rows(metrics(logs))
    assert rows(velocity.with_previous_event(stored).select("bid_request_id", "prev_timestamp")) == rows(
        velocity.with_previous_event(logs).select("bid_request_id", "prev_timestamp")
    )


def test_a_hot_address_is_spread_over_buckets(stored):
    files = stored.where("ip_address = 'hot'").select(F.col("_metadata.file_name")).distinct().count()
    assert files >= 2  # three minutes of it, in buckets of their own


def test_empty_logs(spark, logs, tmp_path):
    name = f"logs_{uuid.uuid4().hex}"
    empty = bucketed.write_bucketed(logs.limit(0), name, 2, path=str(tmp_path / "t"))
    assert rows(fused.detector_metrics(empty)) == []
    spark.sql(f"DROP TABLE {name}")
