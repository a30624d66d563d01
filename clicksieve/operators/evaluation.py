"""How good is the click rule? Confusion counts, rates, sweep, ROC and money."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from clicksieve.functions.columns import (
    AsOf,
    as_timestamp,
    harmonic_mean,
    lookup,
    percent,
    ratio,
    round2,
)
from clicksieve.rules import EVALUATION, EvaluationRules
from clicksieve.session import work_folder

TP, TN, FP, FN = "TRUE_POSITIVE", "TRUE_NEGATIVE", "FALSE_POSITIVE", "FALSE_NEGATIVE"


def with_revenue(labels: DataFrame, rules: EvaluationRules = EVALUATION) -> DataFrame:
    """Money lost if the address were blocked; bots bring none."""
    by_type = lookup(F.col("user_type"), rules.revenue_by_user_type, rules.revenue_otherwise)
    return labels.withColumn(
        "revenue_impact", F.when(F.col("is_actually_bot"), F.lit(0.0)).otherwise(by_type)
    )


def ground_truth_profile(traffic: DataFrame) -> DataFrame:
    return (
        traffic.groupBy("user_type")
        .agg(
            F.count(F.lit(1)).alias("ip_count"),
            F.sum("total_clicks").alias("total_clicks"),
            F.sum(F.col("is_actually_bot").cast("int")).alias("bot_count"),
        )
        .orderBy(F.desc("bot_count"), F.desc("ip_count"), "user_type")
    )


def _outcome(predicted: Column, actual: Column) -> Column:
    """Confusion cell; NULL when the label is."""
    hit = F.when(predicted, F.lit(TP)).otherwise(F.lit(FN))
    miss = F.when(predicted, F.lit(FP)).otherwise(F.lit(TN))
    return F.when(actual, hit).when(~actual, miss)


def model_performance(
    traffic: DataFrame,
    threshold: int | None = None,
    analysis_date: AsOf = None,
    rules: EvaluationRules = EVALUATION,
) -> DataFrame:
    """Prediction of the click rule per address, with cell and impact text."""
    limit = rules.block_above_clicks if threshold is None else threshold
    return (
        traffic.withColumn("predicted_as_bot", F.coalesce(F.col("total_clicks") > limit, F.lit(False)))
        .withColumn("evaluation_category", _outcome(F.col("total_clicks") > limit, F.col("is_actually_bot")))
        .withColumn("business_impact", lookup(F.col("evaluation_category"), rules.impact_texts, None))
        .withColumn("analysis_date", as_timestamp(analysis_date).cast("timestamp_ntz"))
    )


def with_share(counted: DataFrame, count: str, share: str) -> DataFrame:
    """Percentage of the total, over an already grouped and therefore small frame."""
    everything = Window.partitionBy()
    return counted.withColumn(share, round2(percent(F.col(count), F.sum(count).over(everything))))


def confusion_summary(performance: DataFrame) -> DataFrame:
    grouped = performance.groupBy("evaluation_category", "business_impact").agg(
        F.count(F.lit(1)).alias("ip_count"),
        F.sum("revenue_impact").alias("total_revenue_impact"),
    )
    place = lookup(F.col("evaluation_category"), ((TP, 1), (TN, 2), (FP, 3), (FN, 4)), None)
    return with_share(grouped, "ip_count", "percentage").orderBy(F.asc_nulls_last(place))


def _in(cell: str) -> Column:
    return F.col("evaluation_category") == cell


def _confusion_aggregates() -> list[Column]:
    return [
        F.count_if(_in(TP)).alias("tp"),
        F.count_if(_in(TN)).alias("tn"),
        F.count_if(_in(FP)).alias("fp"),
        F.count_if(_in(FN)).alias("fn"),
        F.sum(F.when(_in(FP), F.col("revenue_impact")).otherwise(0.0)).alias("fp_revenue_loss"),
    ]


def _precision() -> Column:
    return percent(F.col("tp"), F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return percent(F.col("tp"), F.col("tp") + F.col("fn"))


def _rates() -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return {
        "precision_percent": round2(_precision()),
        "recall_percent": round2(_recall()),
        "specificity_percent": round2(percent(tn, tn + fp)),
        "f1_score": round2(harmonic_mean(_precision(), _recall())),
        "accuracy_percent": round2(percent(tp + tn, tp + tn + fp + fn)),
    }


def classification_metrics(performance: DataFrame) -> DataFrame:
    """One row: counts, rates in percent, and what they mean for the business."""
    return performance.agg(*_confusion_aggregates()).select(
        F.col("tp").alias("true_positives"),
        F.col("tn").alias("true_negatives"),
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
        *[value.alias(name) for name, value in _rates().items()],
        F.col("fp").alias("users_incorrectly_blocked"),
        F.col("fp_revenue_loss").alias("estimated_revenue_loss_usd"),
        F.col("fn").alias("bots_missed"),
        F.col("tp").alias("bots_correctly_blocked"),
        F.col("tn").alias("humans_correctly_allowed"),
    )


def user_type_breakdown(performance: DataFrame) -> DataFrame:
    place = lookup(F.col("evaluation_category"), ((FP, 1), (FN, 2), (TP, 3), (TN, 4)), None)
    return (
        performance.groupBy("user_type", "evaluation_category", "business_impact")
        .agg(
            F.count(F.lit(1)).alias("ip_count"),
            F.sum("revenue_impact").alias("revenue_impact"),
            F.avg("total_clicks").alias("avg_clicks"),
        )
        .orderBy(F.asc_nulls_last(place), F.desc_nulls_first("revenue_impact"), F.asc_nulls_last("user_type"))
    )


def threshold_sweep(
    traffic: DataFrame, thresholds: Sequence[int] | None = None, rules: EvaluationRules = EVALUATION
) -> DataFrame:
    """Confusion counts and scores for every threshold, from one pass.

    A row is never paired with each threshold. It is reduced to how many
    thresholds its clicks exceed, rows are summed per such rank, and the few
    rank sums are then added up per threshold: predicted positive for the
    i-th lowest threshold means rank above i.
    """
    cuts = sorted(rules.sweep_thresholds if thresholds is None else thresholds)
    if len(set(cuts)) != len(cuts):
        raise ValueError("thresholds must differ")
    rank = sum(((F.col("total_clicks") > c).cast("int") for c in cuts), F.lit(0))
    bot = F.col("is_actually_bot")
    per_rank = traffic.groupBy(rank.alias("rank")).agg(
        F.count_if(bot).alias("bots"),
        F.count_if(~bot).alias("humans"),
        F.sum(F.when(~bot, F.col("revenue_impact")).otherwise(0.0)).alias("human_revenue"),
    )
    each_cut = F.explode(
        F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("click_threshold")) for i, c in enumerate(cuts)])
    )
    over = F.col("rank") > F.col("cut.place")

    def add(amount: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(amount)).otherwise(0))

    counts = (
        per_rank.where(F.col("rank").isNotNull())
        .withColumn("cut", each_cut)
        .groupBy(F.col("cut.click_threshold").alias("click_threshold"))
        .agg(
            add("bots", over).alias("tp"),
            add("humans", ~over).alias("tn"),
            add("humans", over).alias("fp"),
            add("bots", ~over).alias("fn"),
            add("human_revenue", over).alias("fp_revenue_loss"),
        )
    )
    protection = F.lit(100.0) - F.col("fp_revenue_loss") / F.lit(rules.revenue_scale)
    recommendation = (
        _precision() * F.lit(rules.precision_weight)
        + _recall() * F.lit(rules.recall_weight)
        + protection * F.lit(rules.revenue_weight)
    )
    return counts.select(
        "click_threshold",
        "tp",
        "tn",
        "fp",
        "fn",
        round2(_precision()).alias("precision"),
        round2(_recall()).alias("recall"),
        round2(harmonic_mean(_precision(), _recall())).alias("f1_score"),
        F.col("fp").alias("users_blocked_incorrectly"),
        F.col("fp_revenue_loss").alias("revenue_loss_usd"),
        F.col("fn").alias("bots_missed"),
        round2(recommendation).alias("recommendation_score"),
    ).orderBy(F.desc_nulls_first("recommendation_score"), "click_threshold")


def evaluation_report(performance: DataFrame, analysis_date: AsOf = None) -> DataFrame:
    """The closing report: five numbers from one aggregation instead of five scans."""
    return performance.agg(
        F.lit("MODEL_EVALUATION_COMPLETE").alias("status"),
        F.count(F.lit(1)).alias("total_ips_analyzed"),
        F.count_if(_in(TP)).alias("true_positives"),
        F.count_if(_in(FP)).alias("false_positives"),
        F.count_if(_in(FN)).alias("false_negatives"),
        F.sum(F.when(_in(FP), F.col("revenue_impact"))).alias("estimated_revenue_loss"),
    ).withColumn("analysis_timestamp", as_timestamp(analysis_date).cast("timestamp_ntz"))


def confusion_matrix(performance: DataFrame) -> DataFrame:
    """Two by two: actual rows, predicted columns."""
    return (
        performance.where(F.col("is_actually_bot").isNotNull())
        .groupBy(F.when(F.col("is_actually_bot"), F.lit("Bot")).otherwise(F.lit("Human")).alias("actual"))
        .agg(
            F.count_if(F.col("predicted_as_bot")).alias("predicted_bot"),
            F.count_if(~F.col("predicted_as_bot")).alias("predicted_human"),
        )
    )


def net_savings(performance: DataFrame, budget_per_click: float = 1.0) -> DataFrame:
    """Ad budget saved by blocked bots, less revenue lost on blocked people."""
    return (
        performance.agg(
            F.sum(F.when(_in(TP), F.col("total_clicks")).otherwise(0)).alias("_blocked_clicks"),
            F.sum(F.when(_in(FP), F.col("revenue_impact")).otherwise(0.0)).alias("false_positive_cost"),
            F.count_if(_in(TP)).alias("bots_blocked"),
            F.count_if(_in(FP)).alias("users_blocked"),
        )
        .withColumn("fraud_prevented", F.col("_blocked_clicks").cast("double") * F.lit(float(budget_per_click)))
        .withColumn("net_savings", F.col("fraud_prevented") - F.col("false_positive_cost"))
        .drop("_blocked_clicks")
    )


def model_drift(performance: DataFrame) -> DataFrame:
    """The rates by evaluation date."""
    return (
        performance.groupBy("evaluation_date")
        .agg(*_confusion_aggregates())
        .select("evaluation_date", "tp", "tn", "fp", "fn", *[v.alias(n) for n, v in _rates().items()])
    )


def review_queue(traffic: DataFrame, clicks: tuple[int, int] | None = None, rules: EvaluationRules = EVALUATION) -> DataFrame:
    """Borderline addresses for manual review, both ends included."""
    low, high = clicks or rules.review_clicks
    return traffic.where(F.col("total_clicks").between(low, high))


# ROC --------------------------------------------------------------------------

_BLOCK_BITS = 16
RANGE = "_block"
SCORES_PER_FILE = 1_000_000


def label_counts(traffic: DataFrame, score: str, kind: str) -> DataFrame:
    """Labelled rows per distinct score: score, bots, humans."""
    bot = F.col("is_actually_bot")
    return (
        traffic.where(bot.isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).cast(kind).alias("score"))
        .agg(F.count_if(bot).alias("bots"), F.count_if(~bot).alias("humans"))
    )


def ranked(rows: DataFrame, by: str, rows_per_file: int = SCORES_PER_FILE) -> DataFrame:
    """The rows with the number of a range of neighbouring ``by``; higher numbers hold higher ``by``.

    A sort cuts the rows at sampled quantiles, so ranges hold alike many rows
    wherever the values lie; it is written once, each range to files of at most
    ``rows_per_file`` rows, and a file is a range. Neither the cut nor the
    numbers change when a task is run again.
    """
    folder = work_folder(rows.sparkSession, "ranked")
    rows.orderBy(F.desc(by)).write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
    name = F.col("_metadata.file_name")
    place = [F.regexp_extract(name, pattern, 1).cast("bigint") for pattern in (r"^part-(\d+)", r"-c(\d+)")]
    stored = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    return stored.withColumn(RANGE, -(place[0] * 1_000_000 + place[1]))


def _score_counts(traffic: DataFrame, score: str) -> DataFrame:
    """Cumulative label counts per distinct score, highest score first.

    A running sum over all scores would sort them in one task. Scores are cut
    into blocks instead, and the running sum over block totals sees one row
    per block. Whole numbers are cut every 65,536 values, so the window inside
    a block sees at most that many rows. Other scores keep their fractions and
    are cut by rank, see ``ranked``; infinite scores stand at the ends and NaN
    above all, as Spark sorts them.
    """
    whole = isinstance(traffic.schema[score].dataType, (ByteType, ShortType, IntegerType, LongType))
    if whole:
        per_score = label_counts(traffic, score, "bigint")
        per_score = per_score.withColumn(RANGE, F.shiftright("score", _BLOCK_BITS).cast("bigint"))
    else:
        per_score = ranked(label_counts(traffic, score, "double"), "score")
    higher_blocks = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        per_score.groupBy("_block")
        .agg(F.sum("bots").alias("_bots"), F.sum("humans").alias("_humans"))
        .select(
            "_block",
            F.coalesce(F.sum("_bots").over(higher_blocks), F.lit(0)).alias("_bots_above"),
            F.coalesce(F.sum("_humans").over(higher_blocks), F.lit(0)).alias("_humans_above"),
            F.sum("_bots").over(Window.partitionBy()).alias("all_bots"),
            F.sum("_humans").over(Window.partitionBy()).alias("all_humans"),
        )
    )
    in_block = (
        Window.partitionBy("_block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    )
    return per_score.join(blocks, "_block").select(
        "score",
        "bots",
        "humans",
        (F.col("_bots_above") + F.sum("bots").over(in_block)).alias("tp"),
        (F.col("_humans_above") + F.sum("humans").over(in_block)).alias("fp"),
        "all_bots",
        "all_humans",
    )


def roc_curve(traffic: DataFrame, score: str = "total_clicks") -> DataFrame:
    """One point per distinct score: predict a bot from this score upwards."""
    return _score_counts(traffic, score).select(
        F.col("score").alias("score_at_least"),
        "tp",
        "fp",
        ratio(F.col("tp"), F.col("all_bots")).alias("tpr"),
        ratio(F.col("fp"), F.col("all_humans")).alias("fpr"),
    )


def roc_auc(traffic: DataFrame, score: str = "total_clicks") -> DataFrame:
    """Area under the curve by trapezoids, from whole-number sums.

    A step adds ``humans`` to the width and covers the mean of the heights
    before and after it, so twice the area is ``humans * (2 * tp - bots)``.
    """
    doubled = F.col("humans").cast("decimal(19,0)") * (F.lit(2) * F.col("tp") - F.col("bots")).cast("decimal(19,0)")
    sums = _score_counts(traffic, score).agg(
        F.sum(doubled).alias("_doubled"), F.max("all_bots").alias("bots"), F.max("all_humans").alias("humans")
    )
    whole = F.lit(2.0) * F.col("bots").cast("double") * F.col("humans").cast("double")
    return sums.select("bots", "humans", ratio(F.col("_doubled"), whole).alias("auc"))


# Data quality -----------------------------------------------------------------


def data_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and share of NULLs for every column, from one aggregation."""
    names = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names]
    )
    return counted.unpivot("row_count", names, "column_name", "null_count").select(
        "column_name",
        "row_count",
        "null_count",
        round2(percent(F.col("null_count"), F.col("row_count"))).alias("null_percent"),
    )
