from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clicksieve.operators import reporting, staged_filters
from clicksieve.plans import jobs
from clicksieve.session import work_folder
from clicksieve.sources import adapters, bid_logs, tables
from tests.conftest import SF_DIR, rows

AS_OF = datetime(2024, 1, 31)
DAY_MS = 86_400_000


def test_trailing_window_keeps_its_edge_and_the_future(make_logs):
    logs = make_logs([("edge", 0), ("old", -1), ("new", DAY_MS + 5)])
    assert {r.ip_address for r in bid_logs.trailing_window(logs, AS_OF).collect()} == {"edge", "new"}


def test_json_round_trip_and_corrupt_lines(spark, make_logs, tmp_path):
    logs = make_logs([("a", 1.5), ("b", 2, {"event_type": None, "user_agent": None})])
    bid_logs.write_json(logs, str(tmp_path / "j"))
    half_bad = '{"bid_request_id":"h","timestamp":"2024-01-30T00:00:00.000000","ip_address":"c","time_to_click_ms":"oops"}\n'
    (tmp_path / "j" / "extra.json").write_text('{"broken\n{"ip_address": "no time"}\n' + half_bad)
    typed, rejected = bid_logs.read_json(spark, str(tmp_path / "j"))
    assert rows(typed) == rows(bid_logs.with_defaults(logs))
    lines = {r[bid_logs.CORRUPT] for r in rejected.collect()}
    assert lines == {'{"broken', half_bad.strip(), None} and rejected.count() == 3


def test_layout_prunes_dates_and_keeps_all_rows(spark, make_logs, tmp_path):
    logs = make_logs([("hot", i * 1000) for i in range(500)] + [("old", -i * DAY_MS - 1) for i in range(5)])
    folder = str(tmp_path / "dated")
    bid_logs.write_layout(logs, folder, files=4)
    stored = spark.read.parquet(folder)
    assert rows(stored.select(*logs.columns)) == rows(logs)
    recent = bid_logs.trailing_window(stored, AS_OF)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in plan
    files = recent.where("ip_address = 'hot'").select(F.input_file_name()).distinct().count()
    assert files > 1  # a hot address is split over files


def test_parquet_reader_and_stamps(spark, make_logs, tmp_path):
    make_logs([("a", 1, {"event_type": None})]).write.parquet(str(tmp_path / "p"))
    row = bid_logs.stamped(bid_logs.read_parquet(spark, str(tmp_path / "p")), AS_OF).first()
    assert (row.event_type, row.processed_at) == ("click", AS_OF)


def test_jobs_end_to_end(spark, tmp_path):
    out = jobs.Tables.under(str(tmp_path))
    done = jobs.run_all(spark, adapters.bid_logs(spark, SF_DIR), out, AS_OF)
    summary = done["filtering"].summary
    assert summary["filtering"][0]["total_suspects"] == done["filtering"].written.count() == 6
    assert summary["volume"][0]["suspect_count"] == 5 and summary["velocity"][0]["suspect_count"] == 3
    assert done["classification"].written.count() == 6
    assert sum(r["ip_count"] for r in done["scoring"].summary["levels"]) == 6
    assert sum(r["alert_count"] for r in done["classification"].summary["actions"]) == 6
    again = jobs.run_all(spark, adapters.bid_logs(spark, SF_DIR), out, AS_OF)
    assert rows(again["classification"].written) == rows(tables.read(spark, out.alerts))


def test_jobs_without_input(spark, make_logs, tmp_path):
    out = jobs.Tables.under(str(tmp_path))
    done = jobs.run_all(spark, make_logs([("old", -5 * DAY_MS)]), out, AS_OF)
    assert done["scoring"].written is None and "classification" not in done


def test_evaluation_job(spark, tmp_path):
    from clicksieve.sources.inline import labelled_sample

    done = jobs.run_evaluation(labelled_sample(spark), jobs.Tables.under(str(tmp_path)), AS_OF)
    assert done.summary["metrics"][0]["accuracy_percent"] == 52.38
    assert done.summary["sweep"][0]["click_threshold"] == 80


def test_catalog_tables(spark, make_logs):
    spark.sql("DROP TABLE IF EXISTS clicksieve_probe")
    stored = tables.overwrite(make_logs([("a", 1)]), "clicksieve_probe")
    assert stored.count() == 1
    assert tables.overwrite(make_logs([("a", 1), ("b", 1)]), "clicksieve_probe").count() == 2
    spark.sql("DROP TABLE clicksieve_probe")


def test_a_table_may_be_replaced_by_what_is_read_from_it(spark, make_logs, tmp_path):
    target = str(tmp_path / "t")
    stored = tables.overwrite(make_logs([("a", 1), ("b", 2)]), target)
    kept = tables.overwrite(stored.where("ip_address = 'a'"), target)
    assert [r.ip_address for r in kept.collect()] == ["a"]
    with pytest.raises(Exception):  # noqa: B017
        tables.overwrite(kept.select(F.raise_error(F.lit("broken")).alias("x")), target)
    assert tables.read(spark, target).count() == 1


def test_history_equals_one_run_per_day(spark, make_logs):
    events = [(ip, day * DAY_MS + i * 40, {"user_agent": f"u{i % 7}"}) for day in range(3) for ip in ("a", "b") for i in range(9)]
    events += [("edge", DAY_MS - 10), ("edge", DAY_MS + 10)]  # fast across midnight, but on two days
    logs = make_logs(events)
    history = jobs.alert_history(logs).select("ip_address", F.to_date("created_at").alias("d"), "risk_score", "total_clicks")
    daily = []
    from clicksieve.operators import fused, scoring

    for day in ("2024-01-30", "2024-01-31", "2024-02-01"):
        one = logs.where(F.to_date("timestamp") == F.lit(day).cast("date"))
        scored = scoring.risk_scores(fused.suspect_ips(one, day), day)
        daily.append(scored.select("ip_address", F.lit(day).cast("date").alias("d"), "risk_score", "total_clicks"))
    assert rows(history) == rows(daily[0].union(daily[1]).union(daily[2]))
    assert history.where("ip_address = 'edge'").count() == 0


def test_rates_and_filters(spark, make_logs):
    kinds = {"good": ["click"] + ["view"] * 4, "bot": ["click"] * 9 + ["view"], "none": ["click"], "trusted": ["click"] + ["view"] * 4}
    logs = make_logs([(ip, i, {"event_type": k}) for ip, ks in kinds.items() for i, k in enumerate(ks)])
    rates = staged_filters.engagement_rates(logs)
    got = {r.ip_address: (r.ctr, r.conversion_rate) for r in rates.collect()}
    assert got == {"good": (0.25, 0.0), "bot": (9.0, 0.0), "none": (None, 0.0), "trusted": (0.25, 0.0)}
    allow = spark.createDataFrame([("trusted",), (None,)], "ip_address string")
    assert [r.ip_address for r in staged_filters.quality_filter(rates, allow).collect()] == ["good"]
    assert staged_filters.without_trusted(rates, allow).count() == 3


def test_fraud_filter(spark):
    df = spark.createDataFrame(
        [("a", 0.71, 0.0, 0.0), ("b", 0.7, 0.9, 0.8), ("c", 0.0, 0.91, 0.0), ("d", 0.0, 0.0, 0.81), ("e", None, None, None)],
        "ip_address string, risk_score double, velocity_score double, p double",
    )
    assert {r.ip_address for r in staged_filters.fraud_filter(df, F.col("p")).collect()} == {"a", "c", "d"}


def test_weekdays_and_unknown_country(spark):
    df = spark.createDataFrame(
        [("x", datetime(2024, 1, 29), "ZZ", "LOW", 5), ("y", datetime(2024, 2, 4, 23), "US", "LOW", 7)],
        "alert_id string, created_at timestamp_ntz, country_code string, risk_level string, total_clicks bigint",
    )
    assert [r.day_of_week for r in reporting.alerts_by_weekday(df).collect()] == ["Monday", "Sunday"]
    assert [r.hour_of_day for r in reporting.alerts_by_hour(df).collect()] == [0, 23]
    assert {(r.country_code, r.lat, r.lon) for r in reporting.geo_points(df).collect()} == {
        ("ZZ", 0.0, 0.0), ("US", 37.0902, -95.7129),
    }


def test_work_folder_needs_a_shared_parent_on_a_cluster(spark):
    assert work_folder(spark, "a") != work_folder(spark, "a")

    class Conf:
        def get(self, key, default):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        work_folder(Cluster(), "a")
