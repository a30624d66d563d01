"""What one task sorts and what travels between tasks stays small, however large the logs are."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from clicksieve.operators import fused, velocity
from clicksieve.sources import bid_logs, bucketed
from tests.test_plans import plan


@pytest.fixture(scope="module")
def many(spark, make_logs):
    """1.1 million events of one address within a day."""
    one = make_logs([("hot", 0)])
    at = F.lit(one.first().timestamp) + F.expr("make_interval(0, 0, 0, 0, 0, 0, cast(id * 70 as decimal(18,6)) / 1000)")
    return spark.range(1_100_000).select(
        *[(at if f.name == "timestamp" else F.lit(one.first()[f.name])).cast(f.dataType).alias(f.name) for f in one.schema]
    )


def test_layout_has_a_task_for_half_a_million_rows(spark, many, tmp_path):
    bid_logs.write_layout(many, str(tmp_path / "dated"), files=1)
    stored = spark.read.parquet(str(tmp_path / "dated"))
    loads = [r["count"] for r in stored.groupBy(F.col("_metadata.file_name")).count().collect()]
    assert sum(loads) == 1_100_000 and len(loads) >= 3 and max(loads) <= 600_000


def test_buckets_follow_the_number_of_rows(spark, many, tmp_path):
    name = f"logs_{uuid.uuid4().hex}"
    stored = bucketed.write_bucketed(many, name, 1, path=str(tmp_path / "bucketed"))
    assert stored.count() == 1_100_000
    said = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert said["Num Buckets"] == "3"
    spark.sql(f"DROP TABLE {name}")


def test_raw_rows_are_dealt_out_widely_whatever_the_session_says(many):
    for metrics in (velocity.velocity_metrics(many), fused.detector_metrics(many)):
        dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\)", plan(metrics))]
        assert dealt and min(dealt) >= 1000


def test_rows_carry_only_what_is_needed(make_logs):
    logs = make_logs([("a", i * i, {"user_agent": f"u{i % 7}"}) for i in range(400)])
    reduced = fused._reduced(logs, ("ip_address",), 60)
    presence, gaps = reduced.where(F.col("kind") != fused.GAPS), reduced.where(F.col("kind") == fused.GAPS)
    assert presence.count() >= 9
    assert presence.where("_slice is not null or clicks is not null or first_ts is not null or last_ts is not null").count() == 0
    slices = gaps.select("_slice").distinct().count()
    assert gaps.count() >= 390 and gaps.agg(F.sum("clicks")).first()[0] == 400
    assert gaps.where("first_ts is not null").count() <= 2 * slices and gaps.where("last_ts is not null").count() == slices
