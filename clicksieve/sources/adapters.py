"""Views of the given tables in the log and label layouts.

``lineitem`` packed into one day gives addresses with thousands of events and
real millisecond gaps; ``events`` gives a long quiet tail over thirty days.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)

# Fixed values of the adapter.
COUNTRIES = ("US", "CN", "RU", "BR", "IN", "DE", "GB", "FR")
DEVICES = ("mobile", "desktop", "tablet")
PACKED_DAY_MS = 1706572800000  # 2024-01-30 00:00:00 UTC
LABEL_THRESHOLD = 2000
SWEEP_THRESHOLDS = (500, 1000, 1500, 2000, 3000, 5000)
REVIEW_BAND = (1500, 2500)


def _pick(names: tuple[str, ...], index: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"element_at(array({listed}), cast({index} as int) + 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_as_logs(lineitem: DataFrame) -> DataFrame:
    keyed = lineitem.selectExpr("*", "cast(floor(sqrt(l_suppkey)) as bigint) + 1 as g")
    return keyed.selectExpr(
        "concat('L-', l_orderkey, '-', l_linenumber) as bid_request_id",
        f"cast(timestamp_millis({PACKED_DAY_MS} + (l_orderkey * 104729 + l_linenumber * 15485863"
        " + l_partkey * 7919) % 86400000) as timestamp_ntz) as timestamp",
        "concat('10.1.0.', g) as ip_address",
        "concat('ua-', l_partkey % (3 * g)) as user_agent",
        "cast(l_quantity as bigint) as time_to_click_ms",
        "concat('c-', l_partkey % (8 * g)) as campaign_id",
        "concat('p-', l_orderkey % (4 * g)) as publisher_id",
        "cast(null as string) as advertiser_id",
        f"{_pick(DEVICES, 'g % 3')} as device_type",
        f"{_pick(COUNTRIES, 'g % 8')} as country_code",
        "cast(null as string) as region",
        "'click' as event_type",
        "cast(null as timestamp_ntz) as processed_at",
    )


def events_as_logs(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "concat('E-', event_id) as bid_request_id",
        "cast(ts as timestamp_ntz) as timestamp",
        "concat('10.2.', user_id div 256, '.', user_id % 256) as ip_address",
        "props as user_agent",
        "cast(floor(value * 10) as bigint) as time_to_click_ms",
        "concat('c-', event_id % 9) as campaign_id",
        "concat('p-', event_id % 4) as publisher_id",
        "cast(null as string) as advertiser_id",
        f"{_pick(DEVICES, 'user_id % 3')} as device_type",
        f"{_pick(COUNTRIES, 'user_id % 8')} as country_code",
        "cast(null as string) as region",
        "event_type",
        "cast(null as timestamp_ntz) as processed_at",
    )


def bid_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_as_logs(table(spark, sf_dir, "lineitem")).unionByName(
        events_as_logs(table(spark, sf_dir, "events"))
    )


def bid_logs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a file stream."""

    def stream(name: str) -> DataFrame:
        schema = table(spark, sf_dir, name).schema
        # A stream wants a folder or a pattern; the bracket makes the path a
        # pattern that matches just this table, stored as one file or many.
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")

    return lineitem_as_logs(stream("lineitem")).unionByName(events_as_logs(stream("events")))


def labelled_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to their documents; only three narrow columns are read."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").cast("string").alias("ip_address"),
        F.col("n_chars").cast("bigint").alias("total_clicks"),
        (F.col("toxic") == 1).alias("is_actually_bot"),
        F.col("source").alias("user_type"),
        F.expr("date_add(date'2024-01-01', cast(doc_id % 30 as int))").alias("evaluation_date"),
    )


def trusted_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of customers in good standing, as the allow list."""
    return (
        table(spark, sf_dir, "customer")
        .where(F.col("c_acctbal") > 5000)
        .selectExpr("concat('10.2.', c_custkey div 256, '.', c_custkey % 256) as ip_address")
    )


def address_reputation(logs: DataFrame) -> DataFrame:
    """Share of an address's events that are errors, as its bad reputation in [0, 1]."""
    return logs.groupBy("ip_address").agg(
        (F.count_if(F.col("event_type") == "error").cast("double") / F.count(F.lit(1))).alias("reputation_risk")
    )
