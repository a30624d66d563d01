"""Registered queries: each operator over the given tables.

``queries()`` gives the Spark form, ``oracle_sql()`` the same result in SQL for
an independent engine. Lists are joined to text and times are given without a
zone, so both sides can be compared value by value.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from clicksieve.functions import udfs  # noqa: E402
from clicksieve.functions.columns import flatten_for_export  # noqa: E402
from clicksieve.operators import (  # noqa: E402
    alerts,
    evaluation,
    fused,
    hourly,
    load_slices,
    reporting,
    scoring,
    staged_filters,
    suspects,
    velocity,
    volume,
)
from clicksieve.plans import gold, jobs  # noqa: E402
from clicksieve.rules import BLOCK, DISMISSED, ESCALATED, EXECUTED, PENDING, STRICT_ACTIONS, StagedFilterRules  # noqa: E402
from clicksieve.session import configure, work_folder  # noqa: E402
from clicksieve.sources import adapters, bid_logs, bucketed, tables  # noqa: E402
from clicksieve.streaming import detect, keyed, sinks  # noqa: E402

try:
    from clicksieve.llm import queries as text_queries  # noqa: E402
except ModuleNotFoundError as missing:
    if missing.name not in ("clicksieve.llm", "corpus_pipeline"):
        raise
    text_queries = None

AS_OF = adapters.AS_OF
STATE_PARTITIONS = 8  # of the registered streams, at least
ROWS_PER_STATE_PARTITION = 2_000_000
LAYOUT_FILES = 16
JSON_FILES = 32  # at least; a quarter of them is a micro-batch, one task each
ROWS_PER_JSON_FILE = 500_000
SMALL_PARTS = 4  # events; the given tables have minutes of an address with more, so that slices are cut
ENTRY_DATA = "/root/testdata/sf0.001"

Query = Callable[[SparkSession, str], DataFrame]


# inputs ------------------------------------------------------------------------


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return adapters.bid_logs(spark, d)


def _recent(spark: SparkSession, d: str) -> DataFrame:
    return bid_logs.trailing_window(_logs(spark, d), AS_OF)


def _volume(spark, d):
    return volume.high_volume_suspects(_recent(spark, d))


def _velocity(spark, d):
    return velocity.high_velocity_suspects(_recent(spark, d))


def _suspects(spark, d):
    return fused.suspect_ips(_recent(spark, d), AS_OF)


def _recent_by_load(spark, d):
    return load_slices.with_load_slices(_recent(spark, d), rows_per_part=SMALL_PARTS)


def _bucketed_suspects(spark, d):
    folder = work_folder(spark, "bucketed-logs")
    name = "bid_logs_" + folder.rsplit("-", 1)[1]
    stored = bucketed.write_bucketed(_logs(spark, d), name, LAYOUT_FILES, path=folder)
    return fused.suspect_ips(bid_logs.trailing_window(stored, AS_OF), AS_OF)


def _hourly_medians(spark, d):
    """Medians of the last day from kept hours, held against the gaps themselves."""
    logs = _logs(spark, d)
    hours = tables.overwrite(hourly.hourly_gaps(logs), work_folder(spark, "hourly-gaps"))
    found = tables.overwrite(hourly.window_metrics(hours, AS_OF), work_folder(spark, "hourly-window"))
    exact = bid_logs.trailing_window(velocity.with_previous_event(logs), AS_OF)
    return found.join(hourly.median_rank(found, exact), "ip_address").select(
        "ip_address", "total_clicks", "fastest_click_ms", "ultra_fast_clicks", "avg_click_interval_ms",
        (F.col("off") <= hourly.RANK_ERROR).alias("median_in_bound"),
    )


def _scores(spark, d):
    return scoring.risk_scores(_suspects(spark, d), AS_OF)


def _alerts(spark, d):
    return alerts.actionable_alerts(_scores(spark, d), AS_OF)


def _history(spark, d):
    return jobs.alert_history(_logs(spark, d))


_STORES: dict[tuple[str, str], gold.AlertStore] = {}


def _new_store(spark, d) -> gold.AlertStore:
    """A kept alert table, filled in two runs: first without the last day of the logs, then with it."""
    folder = work_folder(spark, "gold")
    layout = f"{folder}/logs"
    store = gold.AlertStore(spark, f"{folder}/store")
    before = F.col("timestamp") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")
    bid_logs.write_layout(_logs(spark, d).where(before), layout, LAYOUT_FILES)
    store.backfill(layout)
    bid_logs.write_layout(_logs(spark, d).where(~before), layout, LAYOUT_FILES, mode="append")
    store.backfill(layout)
    return store


def _expired() -> Column:
    return F.col("expires_at") <= F.lit(AS_OF).cast("timestamp_ntz")


def _store(spark, d) -> gold.AlertStore:
    """The kept table that the pages of one application read; blocks are executed and old alerts dismissed."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        store = _new_store(spark, d)
        store.change("1-blocks", F.col("final_action") == BLOCK, EXECUTED, "auto", AS_OF)
        store.change("2-clean-up", _expired(), DISMISSED, "clean-up", AS_OF)
        store.fold()
        _STORES[key] = store
    return _STORES[key]


def _worked(spark, d):
    return _store(spark, d).current().drop(gold.DAY)


def _status_changes(spark, d):
    """Changes of three kinds, some folded into the table and some only recorded."""
    store = _new_store(spark, d)
    store.change("1-blocks", F.col("final_action") == BLOCK, EXECUTED, "auto", AS_OF)
    store.fold()
    store.change("2-escalate", F.col("priority") == "MEDIUM", ESCALATED, "analyst", AS_OF)
    store.change("3-clean-up", _expired(), DISMISSED, "clean-up", AS_OF, only_from=(PENDING, ESCALATED))
    return store.current().select("alert_id", "priority", "final_action", "action_status", "actioned_by", "actioned_at")


def _expired_cleanup(spark, d):
    store = _new_store(spark, d)
    store.expire(AS_OF)
    return store.stored().select("alert_id", F.col(gold.DAY).alias("event_day"), "final_action", "expires_at")


def _traffic(spark, d):
    return evaluation.with_revenue(adapters.labelled_traffic(spark, d))


def _performance(spark, d):
    return evaluation.model_performance(_traffic(spark, d), adapters.LABEL_THRESHOLD, AS_OF)


def _rates(spark, d):
    return staged_filters.engagement_rates(_logs(spark, d))


def _stream(spark, d):
    partitions = bid_logs.writing_tasks(_logs(spark, d).select("timestamp"), STATE_PARTITIONS, ROWS_PER_STATE_PARTITION)
    return adapters.bid_logs_stream(sinks.stream_session(spark, partitions), d)


def _timed_stream(spark, d):
    return detect.with_event_time(_stream(spark, d))


# queries that need more than one step ---------------------------------------------


def _rounded_spread(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("click_interval_stddev", F.round("click_interval_stddev", 3))


def _json_ingest(spark, d):
    folder = work_folder(spark, "json-logs")
    bid_logs.write_json(_logs(spark, d), folder)
    typed, _ = bid_logs.read_json(spark, folder)
    return typed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("ip_address").alias("addresses"),
        F.min("timestamp").alias("first_event"),
        F.max("timestamp").alias("last_event"),
        F.sum("time_to_click_ms").alias("click_ms"),
    )


def _dated_layout(spark, d):
    folder = work_folder(spark, "dated-logs")
    bid_logs.write_layout(_logs(spark, d), folder, LAYOUT_FILES)
    stored = bid_logs.trailing_window(spark.read.parquet(folder), AS_OF)
    return stored.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("ip_address").alias("addresses"),
        F.min("timestamp").alias("first_event"),
        F.max("timestamp").alias("last_event"),
    )


def _with_previous(spark, d):
    return velocity.with_previous_event(_recent(spark, d).select("bid_request_id", "timestamp", "ip_address"))


def _merged(spark, d):
    return suspects.merge_suspects(suspects.combine_detectors(_volume(spark, d), _velocity(spark, d)))


def _signal_weights(spark, d):
    return scoring.signal_weight_score(
        _suspects(spark, d), scoring.device_variety(_recent(spark, d)), suspicious_countries=("CN", "RU")
    )


def _ratio_score(spark, d):
    metrics = velocity.velocity_metrics(_recent(spark, d))
    scored = scoring.ratio_score(metrics, adapters.address_reputation(_logs(spark, d)))
    return scored.withColumn("ratio_score", F.round("ratio_score", 9))


def _classified(scores: DataFrame, action) -> DataFrame:
    return scores.select("ip_address", "risk_score", "confidence_level", action.alias("final_action"))


_SCORE, _CONFIDENCE = "risk_score", "confidence_level"


def _classify(rules=None):
    kwargs = {} if rules is None else {"rules": rules}
    return lambda s, d: _classified(
        _scores(s, d), alerts.classify_action(F.col(_SCORE), F.col(_CONFIDENCE), **kwargs)
    )


def _classify_in_sql(function: str, register=udfs.register):
    def run(spark, d):
        register(spark)
        return _classified(_scores(spark, d), F.expr(f"{function}({_SCORE}, {_CONFIDENCE})"))

    return run


def _evidence(spark, d):
    text = alerts.evidence_summary(
        *(F.col(c) for c in ("risk_score", "fraud_reasons", "total_clicks", "fastest_click_ms", "country_code"))
    )
    return _scores(spark, d).select("ip_address", text.alias("evidence_summary"))


def _short_evidence(spark, d):
    text = alerts.simple_evidence(*(F.col(c) for c in ("risk_score", "country_code", "total_clicks")))
    return _scores(spark, d).select("ip_address", text.alias("evidence_summary"))


def _stored_alerts(spark, d):
    out = jobs.Tables.under(work_folder(spark, "tables"))
    return jobs.run_all(spark, _logs(spark, d), out, AS_OF)["classification"].written


def _masked(spark, d):
    found = _history(spark, d).select("ip_address", F.col("ip_address").alias("network"), "risk_score")
    return alerts.mask_addresses(alerts.mask_addresses(found, salt="pepper"), column="network")


_WIDE_RATES = StagedFilterRules(ctr_between=(0.01, 1.2), conversion_below=1.0)


def _quality_filter(**rules):
    return lambda s, d: staged_filters.quality_filter(_rates(s, d), adapters.trusted_addresses(s, d), **rules)


def _without_trusted(spark, d):
    return staged_filters.without_trusted(_rates(spark, d), adapters.trusted_addresses(spark, d))


def _fraud_filter(spark, d):
    # all addresses' metrics are written once; suspects and speeds come from there
    metrics = tables.overwrite(fused.detector_metrics(_recent(spark, d)), work_folder(spark, "metrics"))
    found = suspects.finish_suspects(suspects.merge_suspects(fused.combined_suspects(metrics)), AS_OF)
    speed = fused.velocity_metrics(metrics).select(
        "ip_address",
        (F.col("ultra_fast_clicks").cast("double") / F.col("total_clicks")).alias("bot_probability"),
    )
    joined = scoring.risk_scores(found, AS_OF).join(speed, "ip_address", "left")
    return staged_filters.fraud_filter(joined, F.col("bot_probability")).select(
        "ip_address", "risk_score", "velocity_score", "bot_probability"
    )


def _auc(spark, d):
    return evaluation.roc_auc(_traffic(spark, d)).withColumn("auc", F.round("auc", 12))


def _fractional(spark, d):
    return _traffic(spark, d).withColumn("clicks_per_minute", F.col("total_clicks") / F.lit(1440.0))


def _fractional_auc(spark, d):
    return evaluation.roc_auc(_fractional(spark, d), "clicks_per_minute").withColumn("auc", F.round("auc", 12))


def _stream_alerts(spark, d):
    folder = work_folder(spark, "stream-alerts")
    found = detect.suspect_ips(_timed_stream(spark, d))
    alerts_folder = f"{folder}/alerts"
    sinks.finish(
        lambda: sinks.upsert_alerts(found, alerts_folder, f"{folder}/checkpoint"), found.sparkSession, "stream-alerts"
    )
    return spark.read.parquet(alerts_folder).drop(sinks.WINDOW_DAY)


def _json_stream_ingest(spark, d):
    """Logs as JSON, some lines cut off and some without an address, taken in file by file."""
    folder = work_folder(spark, "json-stream")
    by_time = F.col("time_to_click_ms") % 50
    logs = _logs(spark, d)
    nameless = logs.withColumn("ip_address", F.when(~by_time.eqNullSafe(11), F.col("ip_address")))
    files = bid_logs.writing_tasks(logs.select("timestamp"), JSON_FILES, ROWS_PER_JSON_FILE)
    # dealt out as rows and stored compressed: lines take ten times as much
    lines = bid_logs.json_lines(nameless.repartition(files), (by_time == 7).alias("_cut"))
    cut = F.when(F.col("_cut"), F.substring("value", 1, 40)).otherwise(F.col("value"))
    lines.select(cut.alias("value")).write.option("compression", "gzip").text(f"{folder}/lines")
    stream = bid_logs.read_lines_stream(spark, f"{folder}/lines", maxFilesPerTrigger=str(files // 4))
    sinks.finish(lambda: sinks.ingest_json(stream, f"{folder}/stored", f"{folder}/checkpoint"), spark, "json-stream")
    typed, rejected = sinks.ingested(spark, f"{folder}/stored")

    def counted(rows, outcome, address, moment):
        return rows.groupBy(outcome.alias("outcome")).agg(
            F.count(F.lit(1)).alias("lines"), F.count_distinct(address).alias("addresses"),
            F.min(moment).alias("first_event"), F.max(moment).alias("last_event"),
        )

    no_time = F.lit(None).cast("timestamp_ntz")
    return counted(typed, F.concat(F.lit("typed "), F.col("event_type")), F.col("ip_address"), F.col("timestamp")).unionByName(
        counted(rejected, F.concat(F.lit("rejected, "), F.col("reason")), F.lit(None).cast("string"), no_time)
    )


def _by_window_end(windowed: DataFrame) -> DataFrame:
    return windowed.withColumn("window_end", F.col("window.end")).drop("window")


_QUERIES: dict[str, Query] = {
    # logs
    "trailing_window": lambda s, d: _recent(s, d).select("bid_request_id", "timestamp", "ip_address", "event_type"),
    "json_ingest": _json_ingest,
    "dated_layout": _dated_layout,
    "prev_event_time": lambda s, d: _with_previous(s, d).drop("time_diff_ms"),
    "inter_click_gap_ms": lambda s, d: _with_previous(s, d)
    .where(F.col("time_diff_ms").isNotNull())
    .select("bid_request_id", "ip_address", "time_diff_ms"),
    # detectors
    "volume_metrics": lambda s, d: volume.volume_metrics(_recent(s, d)),
    "velocity_metrics": lambda s, d: _rounded_spread(velocity.velocity_metrics(_recent(s, d))),
    "high_volume_suspects": _volume,
    "high_velocity_suspects": lambda s, d: _rounded_spread(_velocity(s, d)),
    "volume_phase_summary": lambda s, d: volume.volume_phase_summary(_volume(s, d)),
    "velocity_phase_summary": lambda s, d: velocity.velocity_phase_summary(_velocity(s, d)),
    "suspects_merged": _merged,
    "suspect_ips": _suspects,
    "suspect_ips_bucketed": _bucketed_suspects,
    "velocity_metrics_by_load": lambda s, d: _rounded_spread(velocity.velocity_metrics(_recent_by_load(s, d))),
    "suspect_ips_by_load": lambda s, d: fused.suspect_ips(_recent_by_load(s, d), AS_OF),
    "hourly_medians": _hourly_medians,
    "filtering_summary": lambda s, d: suspects.filtering_summary(_suspects(s, d)),
    "top_suspects": lambda s, d: suspects.top_suspects(_suspects(s, d)),
    # scores
    "risk_scores": _scores,
    "risk_level_summary": lambda s, d: scoring.risk_level_summary(_scores(s, d)),
    "critical_high_counts": lambda s, d: scoring.critical_high_counts(_scores(s, d)),
    "signal_weight_score": _signal_weights,
    "ratio_score": _ratio_score,
    # alerts
    "classify_action": _classify(),
    "decision_udf": _classify_in_sql(udfs.DECISION_FUNCTION),
    "classify_fraud": _classify(STRICT_ACTIONS),
    "classify_fraud_udf": _classify_in_sql(udfs.STRICT_FUNCTION),
    "decision_sql": _classify_in_sql(f"{udfs.DECISION_FUNCTION}_sql", udfs.register_in_sql),
    "classify_fraud_sql": _classify_in_sql(f"{udfs.STRICT_FUNCTION}_sql", udfs.register_in_sql),
    "evidence_summary": _evidence,
    "simple_evidence": _short_evidence,
    "actionable_alerts": _alerts,
    "stored_alerts": _stored_alerts,
    "action_summary": lambda s, d: alerts.action_summary(_alerts(s, d)),
    "priority_summary": lambda s, d: alerts.priority_summary(_alerts(s, d)),
    "action_required": lambda s, d: alerts.action_required(_alerts(s, d)),
    "alert_history": _history,
    "bulk_status_update": lambda s, d: _worked(s, d).select(
        "alert_id", "final_action", "action_status", "actioned_by", "actioned_at"
    ),
    "status_changes": _status_changes,
    "expired_cleanup": _expired_cleanup,
    "unexpired_alerts": lambda s, d: alerts.unexpired(_history(s, d), AS_OF).select("alert_id", "expires_at"),
    "masked_alerts": _masked,
    # staged filters
    "engagement_rates": _rates,
    "basic_filter": lambda s, d: _rounded_spread(
        staged_filters.basic_filter(velocity.velocity_metrics(_recent(s, d)), AS_OF)
    ),
    "quality_filter": _quality_filter(),
    "quality_filter_wide": _quality_filter(rules=_WIDE_RATES),
    "without_trusted": _without_trusted,
    "fraud_filter": _fraud_filter,
    # pages
    "alert_kpis": lambda s, d: reporting.alert_kpis(_worked(s, d)),
    "period_delta": lambda s, d: reporting.period_delta(_worked(s, d), AS_OF),
    "alerts_by_day": lambda s, d: reporting.alerts_by_day(_worked(s, d)),
    "avg_risk_by_day": lambda s, d: reporting.avg_risk_by_day(_worked(s, d)),
    "alerts_by_hour": lambda s, d: reporting.alerts_by_hour(_worked(s, d)),
    "alerts_by_weekday": lambda s, d: reporting.alerts_by_weekday(_worked(s, d)),
    "action_distribution": lambda s, d: reporting.action_distribution(_worked(s, d)),
    "risk_level_distribution": lambda s, d: reporting.risk_level_distribution(_worked(s, d)),
    "alerts_by_country": lambda s, d: reporting.alerts_by_country(_worked(s, d)),
    "avg_risk_by_country": lambda s, d: reporting.avg_risk_by_country(_worked(s, d)),
    "geo_points": lambda s, d: reporting.geo_points(_worked(s, d)),
    "geo_heatmap": lambda s, d: reporting.geo_heatmap(_worked(s, d)),
    "recent_critical_alerts": lambda s, d: reporting.recent_critical_alerts(_worked(s, d)),
    "alert_list": lambda s, d: reporting.alert_list(
        alerts.filtered(_worked(s, d), priority="LOW", final_action="All", action_status="PENDING")
    ),
    "alert_selection": lambda s, d: reporting.alert_list(alerts.in_selection(_worked(s, d), "2024-01-24", AS_OF)),
    # evaluation
    "traffic_evaluation": _traffic,
    "ground_truth_profile": lambda s, d: evaluation.ground_truth_profile(_traffic(s, d)),
    "model_performance": _performance,
    "confusion_summary": lambda s, d: evaluation.confusion_summary(_performance(s, d)),
    "classification_metrics": lambda s, d: evaluation.classification_metrics(_performance(s, d)),
    "user_type_breakdown": lambda s, d: evaluation.user_type_breakdown(_performance(s, d)),
    "threshold_sweep": lambda s, d: evaluation.threshold_sweep(_traffic(s, d), adapters.SWEEP_THRESHOLDS),
    "evaluation_report": lambda s, d: evaluation.evaluation_report(_performance(s, d), AS_OF),
    "confusion_matrix": lambda s, d: evaluation.confusion_matrix(_performance(s, d)),
    "net_savings": lambda s, d: evaluation.net_savings(_performance(s, d)),
    "model_drift": lambda s, d: evaluation.model_drift(_performance(s, d)),
    "review_queue": lambda s, d: evaluation.review_queue(_traffic(s, d), adapters.REVIEW_BAND).select(
        "ip_address", "total_clicks", "user_type"
    ),
    "roc_curve": lambda s, d: evaluation.roc_curve(_traffic(s, d)),
    "roc_auc": _auc,
    "roc_curve_fractional": lambda s, d: evaluation.roc_curve(_fractional(s, d), "clicks_per_minute"),
    "roc_auc_fractional": _fractional_auc,
    "data_quality": lambda s, d: evaluation.data_quality(_logs(s, d)),
    # streams
    "json_stream_ingest": _json_stream_ingest,
    "stream_dedup": lambda s, d: sinks.drain(
        detect.dedup(_stream(s, d)).select("bid_request_id"), "stream-dedup", s
    ),
    "stream_high_volume": lambda s, d: _by_window_end(
        sinks.drain(detect.high_volume_suspects(_timed_stream(s, d)), "stream-volume", s)
    ),
    "stream_velocity": lambda s, d: _by_window_end(
        sinks.drain(detect.high_velocity_suspects(_timed_stream(s, d)), "stream-velocity", s)
    ),
    "stream_velocity_keyed": lambda s, d: _by_window_end(
        sinks.drain(keyed.high_velocity_suspects(_timed_stream(s, d)), "stream-keyed", s)
    ),
    "stream_alerts": _stream_alerts,
}


def _exported(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten_for_export(query(configure(spark), sf_dir.rstrip("/")))

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Alerts of the last day: both detectors, merge, score, action, evidence."""
    return queries()["actionable_alerts"](spark, ENTRY_DATA)


def queries() -> dict[str, Query]:
    core = {name: _exported(query) for name, query in _QUERIES.items()}
    return core | (text_queries.queries() if text_queries else {})


def oracle_sql() -> dict[str, str]:
    return oracle_queries.oracle_sql() | (text_queries.oracle_sql() if text_queries else {})
