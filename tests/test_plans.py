"""What the plans must not contain, whatever the data."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from clicksieve.operators import fused, velocity, volume
from clicksieve.sources import adapters, bid_logs
from tests.conftest import SF_DIR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|\w+)", plan(df))


@pytest.fixture(scope="module")
def stored(spark, make_logs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("logs") / "dated")
    bid_logs.write_layout(make_logs([("a", i) for i in range(10)]), folder, files=2)
    return bid_logs.trailing_window(spark.read.parquet(folder), adapters.AS_OF)


def test_velocity_sorts_no_raw_rows_by_address_alone(stored):
    first, second = exchanges(velocity.velocity_metrics(stored))[::-1]
    assert "ip_address" in first and "_slice" in first
    assert "ip_address" in second and "_slice" not in second


def test_volume_combines_by_value_before_address(stored):
    outer, middle, inner = exchanges(volume.volume_metrics(stored))
    assert "user_agent" in inner and "user_agent" not in middle and "country_code" not in outer
    before_shuffle = plan(volume.volume_metrics(stored)).rsplit("Exchange", 1)[1]
    assert "HashAggregate" in before_shuffle and "SortAggregate" not in before_shuffle
    first_two_steps = plan(volume.volume_metrics(stored)).split("Exchange", 1)[1]
    assert "SortAggregate(key=[ip_address#" in first_two_steps.split("HashAggregate", 1)[0]
    assert "SortAggregate" not in first_two_steps.split("HashAggregate", 1)[1]


def test_scan_is_filtered_and_narrow(stored):
    text = plan(velocity.velocity_metrics(stored))
    assert "GreaterThanOrEqual(timestamp" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"timestamp", "ip_address", "device_type", "country_code"}


def test_no_python_in_the_main_path(spark):
    text = plan(fused.suspect_ips(adapters.bid_logs(spark, SF_DIR), adapters.AS_OF))
    assert "Python" not in text and "Arrow" not in text


def test_both_detectors_share_one_scan_and_one_exchange_of_raw_rows(stored):
    found = fused.suspect_ips(stored, adapters.AS_OF)
    assert plan(found).count("FileScan") == 1
    last, middle, raw = exchanges(found)
    assert "_slice" in raw and "ip_address" in raw
    assert "value" in middle and "_slice" not in middle and "value" not in last
    # what travels on has been summed up where the raw rows were dealt to
    between = plan(found).split("Exchange hashpartitioning(ip_address", 2)[2].split("Exchange", 1)[0]
    assert "HashAggregate" in between and "Window" in between and "Generate" in between


@pytest.mark.parametrize("name", [n for n in entry._QUERIES if not n.startswith("stream") and n not in
                                  ("json_ingest", "dated_layout", "stored_alerts", "json_stream_ingest", "status_changes", "expired_cleanup")])
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
