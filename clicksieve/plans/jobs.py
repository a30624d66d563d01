"""The jobs a scheduler calls. Each writes its table once and reads it back.

Summaries scan the written table, which is a fraction of a percent of the
input, and come from one aggregation each. Failures are raised, not turned into
a status text: a scheduler must see them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicksieve.functions.columns import AsOf
from clicksieve.operators import alerts as alert_ops
from clicksieve.operators import evaluation, fused, scoring, suspects, velocity, volume
from clicksieve.rules import ACTIONS, DETECTION, EVALUATION, SCORING, ActionRules, DetectionRules, EvaluationRules, ScoringRules
from clicksieve.sources import bid_logs, tables


@dataclass(frozen=True)
class Tables:
    """Where the derived tables live: catalog names or folders."""

    high_volume: str
    high_velocity: str
    suspects: str
    scores: str
    alerts: str
    performance: str
    metrics: str

    @staticmethod
    def under(folder: str) -> "Tables":
        names = ("high_volume", "high_velocity", "suspects", "scores", "alerts", "performance", "metrics")
        return Tables(**{n: f"{folder.rstrip('/')}/{n}" for n in names})


@dataclass(frozen=True)
class JobResult:
    """The written table and the rows of its summary (grouped, so few)."""

    written: DataFrame | None
    summary: dict[str, list[dict]] = field(default_factory=dict)


def _rows(df: DataFrame) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def run_filtering(
    logs: DataFrame, out: Tables, as_of: AsOf, rules: DetectionRules = DETECTION
) -> JobResult:
    """Logs to suspects. The logs are read once, for the metrics of all addresses; the detectors work on these."""
    recent = bid_logs.trailing_window(logs, as_of, rules)
    metrics = tables.overwrite(fused.detector_metrics(recent, rules=rules), out.metrics)
    by_volume = tables.overwrite(volume.flag_high_volume(fused.volume_metrics(metrics), rules), out.high_volume)
    by_velocity = tables.overwrite(velocity.flag_high_velocity(fused.velocity_metrics(metrics), rules), out.high_velocity)
    merged = suspects.merge_suspects(suspects.combine_detectors(by_volume, by_velocity))
    written = tables.overwrite(suspects.finish_suspects(merged, as_of, rules), out.suspects)
    return JobResult(
        written,
        {
            "volume": _rows(volume.volume_phase_summary(by_volume)),
            "velocity": _rows(velocity.velocity_phase_summary(by_velocity)),
            "filtering": _rows(suspects.filtering_summary(written)),
            "top": _rows(suspects.top_suspects(written)),
        },
    )


def run_scoring(spark: SparkSession, out: Tables, as_of: AsOf, rules: ScoringRules = SCORING) -> JobResult:
    found = tables.read(spark, out.suspects)
    if not tables.has_rows(found, "suspects"):
        return JobResult(None)
    written = tables.overwrite(scoring.risk_scores(found, as_of, rules), out.scores)
    return JobResult(
        written,
        {
            "levels": _rows(scoring.risk_level_summary(written)),
            "attention": _rows(scoring.critical_high_counts(written)),
        },
    )


def run_classification(
    spark: SparkSession, out: Tables, as_of: AsOf, rules: ActionRules = ACTIONS, evidence: str = "full"
) -> JobResult:
    scored = tables.read(spark, out.scores)
    if not tables.has_rows(scored, "risk scores"):
        return JobResult(None)
    written = tables.overwrite(alert_ops.actionable_alerts(scored, as_of, rules, evidence), out.alerts)
    return JobResult(
        written,
        {
            "actions": _rows(alert_ops.action_summary(written)),
            "priorities": _rows(alert_ops.priority_summary(written)),
            "attention": _rows(alert_ops.action_required(written)),
        },
    )


def run_evaluation(
    labels: DataFrame,
    out: Tables,
    as_of: AsOf,
    threshold: int | None = None,
    thresholds: tuple[int, ...] | None = None,
    rules: EvaluationRules = EVALUATION,
) -> JobResult:
    traffic = evaluation.with_revenue(labels, rules)
    written = tables.overwrite(evaluation.model_performance(traffic, threshold, as_of, rules), out.performance)
    return JobResult(
        written,
        {
            "confusion": _rows(evaluation.confusion_summary(written)),
            "metrics": _rows(evaluation.classification_metrics(written)),
            "user_types": _rows(evaluation.user_type_breakdown(written)),
            "sweep": _rows(evaluation.threshold_sweep(written, thresholds, rules)),
            "report": _rows(evaluation.evaluation_report(written, as_of)),
        },
    )


def run_all(spark: SparkSession, logs: DataFrame, out: Tables, as_of: AsOf) -> dict[str, JobResult]:
    """Filtering, scoring and classification in order."""
    results = {"filtering": run_filtering(logs, out, as_of)}
    results["scoring"] = run_scoring(spark, out, as_of)
    if results["scoring"].written is not None:
        results["classification"] = run_classification(spark, out, as_of)
    return results


def alert_history(logs: DataFrame, rules: DetectionRules = DETECTION) -> DataFrame:
    """Alerts of every calendar day in the logs, as if the job had run daily.

    One plan for all days: the day is part of the grouping key, so a backfill
    of a year is one scan and not 365. An alert is stamped with the last event
    that day.
    """
    keys = ("ip_address", "event_day")
    dated = logs.withColumn("event_day", F.col("timestamp").cast("date"))
    found = fused.suspect_ips(dated, F.col("last_seen"), rules, keys)
    scored = scoring.risk_scores(found, F.col("last_seen"))
    return alert_ops.actionable_alerts(scored, F.col("detected_at"))
