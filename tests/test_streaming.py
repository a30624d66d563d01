from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from clicksieve.operators import velocity, volume
from clicksieve.sources import bid_logs
from clicksieve.streaming import detect, keyed, sinks
from tests.conftest import START, rows

HOUR = 3_600_000
CLOSER = ("closer", 60 * HOUR)  # far enough to close every window under test


@pytest.fixture
def stream_of(spark, make_logs, tmp_path):
    """One file per list of events, read one file per micro-batch."""

    def build(*batches):
        folder = tmp_path / "in"
        for number, events in enumerate(batches):
            make_logs(events).coalesce(1).write.mode("append").parquet(str(folder))
        return bid_logs.read_stream(spark, str(folder), maxFilesPerTrigger="1")

    return build


def in_window(df, end_hour):
    end = START + timedelta(hours=end_hour)
    return df.where(F.col("window.end") == F.lit(end).cast("timestamp")).drop("window")


def test_repeats_within_the_delay_are_dropped(make_logs, stream_of):
    same = {"bid_request_id": "same"}
    batch = [("a", 1000, same), ("a", 2000, same), ("a", 1000)]
    got = sinks.drain(detect.dedup(stream_of(batch)), "t-dedup")
    assert got.count() == 2 and got.select("bid_request_id").distinct().count() == 2


def test_velocity_windows_equal_batch(make_logs, stream_of):
    events = [("hot", i // 3) for i in range(300)]  # ties within a millisecond
    events += [("hot", 59_990 + i * 7) for i in range(40)]  # across a minute
    events += [("slow", i * 1_900_000) for i in range(20)] + [("single", 5)]
    shuffled = events[::2] + events[1::2][::-1]  # out of order, before the watermark
    timed = detect.with_event_time(stream_of(shuffled, [CLOSER]), "1 hour")
    got = sinks.drain(detect.velocity_metrics(timed), "t-velocity")
    batch = velocity.velocity_metrics(make_logs(events)).drop("median_click_ms", "click_interval_stddev")
    whole_day = in_window(got, 24).select(batch.columns)
    assert rows(whole_day) == rows(batch)
    first_hour = make_logs([e for e in events if e[1] < HOUR])
    batch = velocity.velocity_metrics(first_hour).drop("median_click_ms", "click_interval_stddev")
    assert rows(in_window(got, 1).select(batch.columns)) == rows(batch)


def test_volume_windows_equal_batch(make_logs, stream_of):
    events = [("a", i * 600_000, {"user_agent": f"u{i % 9}", "campaign_id": f"c{i}"}) for i in range(60)]
    events += [("b", 5, {"user_agent": None})]
    timed = detect.with_event_time(stream_of(events, [CLOSER]))
    got = sinks.drain(detect.volume_metrics(timed), "t-volume")
    batch = volume.volume_metrics(make_logs(events))
    assert rows(in_window(got, 24).select(batch.columns)) == rows(batch)


def test_events_later_than_the_watermark_are_dropped(stream_of):
    # A new watermark closes windows in the next batch and drops rows in the one after.
    far = 50 * HOUR
    timed = detect.with_event_time(stream_of([("a", 0), ("a", 20)], [("a", far)], [("a", far + 1)], [("a", 40)], [CLOSER]))
    got = sinks.drain(detect.velocity_metrics(timed), "t-late", allow_late=True)
    assert {r.total_clicks for r in in_window(got, 24).collect()} == {1}
    with pytest.raises(sinks.LateRows):
        sinks.drain(detect.velocity_metrics(timed), "t-late")


def test_late_rows_of_early_batches_are_counted(spark, stream_of):
    """A query's own progress reports are the latest few; the late row is in none of them."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        far = 50 * HOUR
        timed = detect.with_event_time(
            stream_of([("a", 0)], [("a", far)], [("a", far + 1)], [("a", 40)], *[[("a", far + 2 + i)] for i in range(4)])
        )
        with pytest.raises(sinks.LateRows, match="^1 rows"):
            sinks.drain(detect.velocity_metrics(timed), "t-late-early")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_alerts_are_merged_by_address_and_window(spark, stream_of, tmp_path):
    burst = [("bot", i * 5) for i in range(200)] + [("rotator", i * 600_000, {"user_agent": f"u{i}"}) for i in range(7)]
    later = [("bot", 30 * HOUR + i * 5) for i in range(200)]
    timed = detect.with_event_time(stream_of(burst, later, [CLOSER]))
    target = str(tmp_path / "alerts")

    def run(checkpoint):
        sinks.finish(lambda: sinks.upsert_alerts(detect.suspect_ips(timed), target, str(tmp_path / checkpoint)), spark, "alerts")
        return spark.read.parquet(target)

    stored = run("cp")
    before = rows(stored)
    assert {r.ip_address for r in stored.collect()} == {"bot", "rotator"}
    # one row per sliding window and address, in storage
    assert stored.where("ip_address = 'bot'").count() == stored.select("ip_address", "created_at").distinct().where("ip_address = 'bot'").count() == 48
    newest = {r.ip_address: r for r in sinks.current_alerts(stored).collect()}
    assert newest["bot"].created_at == START + timedelta(hours=54)
    assert (newest["bot"].risk_level, newest["bot"].final_action) == ("HIGH", "SEND_TO_MANUAL_REVIEW")
    # nothing new to read; then everything again with a new checkpoint
    assert rows(run("cp")) == before and rows(run("cp2")) == before
    # alerts that saw less of the same windows take nothing away
    seen = spark.read.parquet(target).drop("window_day").withColumn("total_clicks", F.col("total_clicks") - 1)
    assert len(sinks.merge_alerts(seen, target)) == 3 and rows(spark.read.parquet(target)) == before
    assert len(list((tmp_path / "alerts").glob("window_day=*/*.parquet"))) <= 4 * len(list((tmp_path / "alerts").glob("window_day=*")))


def test_merging_leaves_other_days_alone(spark, stream_of, tmp_path):
    target = tmp_path / "alerts"
    day = [("bot", i * 5) for i in range(200)]
    timed = detect.with_event_time(stream_of(day, [CLOSER]))
    sinks.finish(lambda: sinks.upsert_alerts(detect.suspect_ips(timed), str(target), str(tmp_path / "cp")), spark, "alerts")
    stored = spark.read.parquet(str(target)).drop("window_day")
    n, clicks = stored.agg(F.count("alert_id"), F.sum("total_clicks")).first()
    kept = {p: p.stat().st_mtime_ns for p in target.glob("window_day=2024-01-30/*.parquet")}
    one = spark.createDataFrame(stored.where("created_at >= '2024-01-31'").limit(1).collect(), stored.schema)
    fuller = one.withColumn("total_clicks", one["total_clicks"] + 1)
    assert [str(d) for d in sinks.merge_alerts(fuller, str(target))] == ["2024-01-31"]
    after = spark.read.parquet(str(target))
    assert kept and {p: p.stat().st_mtime_ns for p in target.glob("window_day=2024-01-30/*.parquet")} == kept
    assert tuple(after.agg(F.count("alert_id"), F.sum("total_clicks")).first()) == (n, clicks + 1)
    assert sinks.merge_alerts(stored.limit(0), str(target)) == []


def test_alerts_are_not_stored_silently_without_late_rows(spark, stream_of, tmp_path):
    far = 50 * HOUR
    timed = detect.with_event_time(stream_of([("a", 0)], [("a", far)], [("a", far + 1)], [("a", 40)], [CLOSER]))
    with pytest.raises(sinks.LateRows):
        sinks.finish(lambda: sinks.upsert_alerts(detect.suspect_ips(timed), str(tmp_path / "a"), str(tmp_path / "c")), spark, "alerts")


def test_json_stream_keeps_every_line(spark, make_logs, tmp_path):
    source = tmp_path / "lines"
    source.mkdir()
    logs = make_logs([("a", 1.5), ("b", 2, {"event_type": None, "user_agent": "é | \\ \""})])
    good = [r.value for r in bid_logs.json_lines(logs).collect()]
    odd = ['{"broken', "not json", "[1, 2]", "   ", "", '{"bid_request_id":"x","ip_address":"c"}', "{}",
           '{"bid_request_id":"h","timestamp":"2024-01-30T00:00:00.000000","ip_address":"c","time_to_click_ms":"oops"}']
    (source / "1.txt").write_text("\n".join([good[0], *odd[:4]]) + "\n")
    (source / "2.txt").write_text("\n".join([*odd[4:], good[1]]))

    def run(checkpoint):
        stream = bid_logs.read_lines_stream(spark, str(source), maxFilesPerTrigger="1")
        sinks.finish(lambda: sinks.ingest_json(stream, str(tmp_path / "out"), str(tmp_path / checkpoint)), spark, "json")
        return sinks.ingested(spark, str(tmp_path / "out"))

    typed, rejected = run("cp")
    assert rows(typed) == rows(bid_logs.with_defaults(logs))
    assert {(r.line, r.reason) for r in rejected.collect()} == {
        (odd[0], "unreadable"), (odd[1], "unreadable"), (odd[2], "unreadable"), (odd[5], "timestamp"),
        ("{}", "bid_request_id, timestamp, ip_address"), (odd[7], "unreadable"),
    }
    typed, rejected = run("cp")
    assert (typed.count(), rejected.count()) == (2, 6)
    # as a stream of rows, what is no row is left out and none is made up
    assert rows(sinks.drain(bid_logs.read_stream(spark, str(source), fmt="json"), "t-json")) == rows(typed)


@pytest.mark.parametrize("files", ["1", "4", "12"])
def test_keyed_minutes_do_not_depend_on_the_batches(spark, make_logs, stream_of, tmp_path, files):
    events = [("hot", i // 3) for i in range(300)] + [("hot", 59_990 + i * 7) for i in range(40)]
    events += [("slow", i * 1_900_000, {"country_code": "UDC"[i % 3]}) for i in range(20)] + [("single", 5), ("bare", 9, {"device_type": None, "country_code": None})]
    shuffled = events[::2] + events[1::2][::-1]
    stream_of(*[shuffled[i::10] for i in range(10)], [CLOSER], [("closer", 61 * HOUR)])
    session = sinks.stream_session(spark, 2)  # keyed state is kept in RocksDB only
    timed = detect.with_event_time(bid_logs.read_stream(session, str(tmp_path / "in"), maxFilesPerTrigger=files), "12 hours")
    target = str(tmp_path / "out")
    query = sinks.finish(
        lambda: sinks.to_files(keyed.velocity_metrics(timed), target, str(tmp_path / "cp")), session, "keyed"
    )
    batch = velocity.velocity_metrics(make_logs(events)).drop("median_click_ms", "click_interval_stddev")
    got = spark.read.parquet(target)
    assert rows(in_window(got, 24).select(batch.columns)) == rows(batch)
    # minutes that are over have left the state: the two last events and their timers are what it holds
    held = [o["numRowsTotal"] for o in query.lastProgress["stateOperators"] if "transformWithState" in o["operatorName"]]
    assert len(held) == 1 and held[0] <= 8, held
