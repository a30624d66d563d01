"""Many times the given logs, with one address holding a third of all rows.

    python bench_scale.py FOLDER [copies] [step ...]

Writes ``copies`` shifted copies of the sf0.1 logs to FOLDER once (143 copies
are about 100 million events) and times the detectors over them. Steps:
volume, velocity, window (the plain per-address window, for comparison),
suspects, alerts.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicksieve.operators import alerts, fused, scoring, velocity, volume
from clicksieve.session import local_session
from clicksieve.sources import adapters, bid_logs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
HOT = "10.9.9.9"


def scaled_logs(spark, copies: int) -> DataFrame:
    """Copies spread over the day; every third one belongs to a single address.

    The rest keep their address or get one of their own per copy, half and
    half, so there are busy addresses and a long tail.
    """
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    day = F.date_trunc("day", F.col("timestamp").cast("timestamp"))
    shifted = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(day) + F.col("_copy") * 611953) % (
        86_400_000_000
    )
    address = (
        F.when(F.col("_copy") % 3 == 0, F.lit(HOT))
        .when(F.col("_copy") % 3 == 1, F.col("ip_address"))
        .otherwise(F.concat("ip_address", F.lit("-"), F.col("_copy"), F.lit("-"), F.xxhash64("bid_request_id") % 100))
    )
    return (
        adapters.bid_logs(spark, SF_DIR)
        .withColumn("_copy", copy)
        .withColumn("timestamp", F.timestamp_micros(F.unix_micros(day) + shifted).cast("timestamp_ntz"))
        .withColumn("ip_address", address)
        .withColumn("bid_request_id", F.concat("bid_request_id", F.lit("-"), "_copy"))
        .drop("_copy")
    )


def plain_window(logs: DataFrame) -> DataFrame:
    """What the sliced plan replaces: one sort of a whole address."""
    gap = velocity.millis(F.col("timestamp")) - velocity.millis(
        F.lag("timestamp").over(Window.partitionBy("ip_address").orderBy("timestamp"))
    )
    return (
        logs.withColumn("gap", gap)
        .where(F.col("gap").isNotNull())
        .groupBy("ip_address")
        .agg(F.count(F.lit(1)), F.min("gap"), F.avg("gap"), F.percentile("gap", F.lit(0.5)), F.stddev_samp("gap"))
    )


def main(argv: list[str]) -> None:
    folder, copies = argv[0], int(argv[1]) if len(argv) > 1 else 143
    steps = argv[2:] or ["volume", "velocity", "suspects", "alerts"]
    spark = local_session(CORES, shuffle_partitions=64)
    if not os.path.exists(folder):
        started = time.time()
        scaled_logs(spark, copies).repartition(32).write.parquet(folder)
        print(f"write {time.time() - started:.1f}s", flush=True)
    stored = spark.read.parquet(folder)
    print(f"events {stored.count():,}", flush=True)
    logs = bid_logs.trailing_window(stored, adapters.AS_OF)
    plans = {
        "volume": lambda: volume.volume_metrics(logs),
        "velocity": lambda: velocity.velocity_metrics(logs),
        "window": lambda: plain_window(logs),
        "suspects": lambda: fused.suspect_ips(logs, adapters.AS_OF),
        "alerts": lambda: alerts.actionable_alerts(
            scoring.risk_scores(fused.suspect_ips(logs, adapters.AS_OF), adapters.AS_OF), adapters.AS_OF
        ),
    }
    for step in steps:
        started = time.time()
        plans[step]().write.format("noop").mode("overwrite").save()
        print(f"{step} {time.time() - started:.1f}s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
