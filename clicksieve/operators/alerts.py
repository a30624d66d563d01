"""Actions, priorities, evidence and the alert table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicksieve.functions.columns import AsOf, as_timestamp, exact_mean
from clicksieve.rules import (
    ACTIONS,
    ALERT_REASON_TEXT,
    BLOCK,
    DISMISSED,
    ESCALATED,
    EXECUTED,
    MISSING_SCORE,
    PENDING,
    REVIEW,
    ActionRules,
)


def classify_action(score: Column, confidence: Column, rules: ActionRules = ACTIONS) -> Column:
    """Action for a score and a confidence.

    NaN compares greater than every number in Spark; here it satisfies no
    bound, so a NaN score ends up monitored rather than blocked.
    """
    sure = F.coalesce(confidence, F.lit(rules.missing_confidence))

    def reaches(value: Column, bound: float) -> Column:
        over = value >= F.lit(bound) if rules.inclusive else value > F.lit(bound)
        return over & ~F.isnan(value)

    chain = F.when(score.isNull(), F.lit(MISSING_SCORE))
    for action, min_score, min_confidence in rules.tiers:
        holds = reaches(score, min_score)
        if min_confidence is not None:
            holds = holds & reaches(sure, min_confidence)
        chain = chain.when(holds, F.lit(action))
    return chain.otherwise(F.lit(rules.otherwise))


def alert_priority(score: Column, action: Column, rules: ActionRules = ACTIONS) -> Column:
    blocked, reviewed = action == BLOCK, action == REVIEW
    return (
        F.when(blocked & (score >= rules.critical_block_score), F.lit("CRITICAL"))
        .when(blocked, F.lit("HIGH"))
        .when(reviewed & (score >= rules.medium_review_score), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def _two_decimals(score: Column) -> Column:
    return F.round(score.cast("decimal(6,3)"), 2).cast("string")


def _risk_text(score: Column) -> Column:
    shown = F.concat(F.lit("("), _two_decimals(score), F.lit(")"))
    return F.when(score >= 0.90, F.concat(F.lit("Critical risk "), shown)).when(
        score >= 0.70, F.concat(F.lit("High risk "), shown)
    )


def evidence_summary(score: Column, reasons: Column, clicks: Column, fastest_ms: Column, country: Column) -> Column:
    """Text for analysts: only the parts that say something, joined by bars.

    Zero clicks, a zero gap and an empty country say nothing and are left out.
    """
    parts = F.concat_ws(
        " | ",
        _risk_text(score),
        F.when(F.size(reasons) > 0, F.concat(F.lit("Flags: "), F.array_join(F.slice(reasons, 1, 3), ", "))),
        F.when(clicks != 0, F.concat(F.format_number(clicks, 0), F.lit(" clicks"))),
        F.when(
            (fastest_ms != 0) & (fastest_ms < 100),
            F.concat(F.lit("Ultra-fast clicks ("), fastest_ms.cast("string"), F.lit("ms)")),
        ),
        F.when(country != "", F.concat(F.lit("Country: "), country)),
    )
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("Standard risk profile"))


def simple_evidence(score: Column, country: Column, clicks: Column) -> Column:
    """Short text: risk, country code, click count."""
    return F.concat_ws(
        " | ", F.coalesce(_risk_text(score), F.lit("Standard risk")), country, clicks.cast("string")
    )


def expires_at(action: Column, created_at: Column, rules: ActionRules = ACTIONS) -> Column:
    days = F.lit(rules.expiry_days_otherwise)
    for name, count in rules.expiry_days:
        days = F.when(action == name, F.lit(count)).otherwise(days)
    return created_at + F.make_dt_interval(days=days)


def with_actions(scores: DataFrame, rules: ActionRules = ACTIONS) -> DataFrame:
    action = classify_action(F.col("risk_score"), F.col("confidence_level"), rules)
    return scores.withColumn("final_action", action).withColumn(
        "priority", alert_priority(F.col("risk_score"), F.col("final_action"), rules)
    )


def actionable_alerts(
    scores: DataFrame, created_at: AsOf, rules: ActionRules = ACTIONS, evidence: str = "full"
) -> DataFrame:
    """The stored alert table, 17 columns. One clock value stamps the whole batch."""
    now = as_timestamp(created_at)
    score, clicks, country = F.col("risk_score"), F.col("total_clicks"), F.col("country_code")
    text = {
        "full": evidence_summary(score, F.col("fraud_reasons"), clicks, F.col("fastest_click_ms"), country),
        "simple": simple_evidence(score, country, clicks),
    }[evidence]
    return with_actions(scores, rules).select(
        F.concat(F.lit("ALERT-"), F.col("ip_address"), F.lit("-"), F.date_format(now, "yyyyMMddHHmmss")).alias(
            "alert_id"
        ),
        "ip_address",
        "final_action",
        "priority",
        "risk_score",
        "risk_level",
        F.lit(ALERT_REASON_TEXT).alias("fraud_reason"),
        text.alias("evidence_summary"),
        F.lit(PENDING).alias("action_status"),
        F.lit(None).cast("string").alias("actioned_by"),
        F.lit(None).cast("timestamp_ntz").alias("actioned_at"),
        now.cast("timestamp_ntz").alias("created_at"),
        expires_at(F.col("final_action"), now, rules).cast("timestamp_ntz").alias("expires_at"),
        "confidence_level",
        "country_code",
        "total_clicks",
        "fastest_click_ms",
    )


def action_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("final_action").agg(
        F.count("ip_address").alias("alert_count"),
        exact_mean(F.col("risk_score")).alias("avg_risk_score"),
    )


def priority_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("priority").agg(F.count("ip_address").alias("alert_count"))


def action_required(alerts: DataFrame) -> DataFrame:
    """Blocks to execute and reviews to do, counted in one pass."""
    return alerts.agg(
        F.count_if(F.col("final_action") == BLOCK).alias("blocks_required"),
        F.count_if(F.col("final_action") == REVIEW).alias("reviews_pending"),
    )


def update_status(
    alerts: DataFrame, matches: Column, status: str, actor: str, at: AsOf, only_from: tuple[str, ...] = (PENDING,)
) -> DataFrame:
    """Set a status, an actor and a time on open alerts that match.

    A rewrite of the table, not an update in place: write the result to a new
    folder or table and swap.
    """
    hit = F.coalesce(matches, F.lit(False)) & F.col("action_status").isin(*only_from)
    stamp = as_timestamp(at).cast("timestamp_ntz")
    return alerts.withColumns(
        {
            "action_status": F.when(hit, F.lit(status)).otherwise(F.col("action_status")),
            "actioned_by": F.when(hit, F.lit(actor)).otherwise(F.col("actioned_by")),
            "actioned_at": F.when(hit, stamp).otherwise(F.col("actioned_at")),
        }
    )


def execute_all_blocks(alerts: DataFrame, actor: str, at: AsOf) -> DataFrame:
    return update_status(alerts, F.col("final_action") == BLOCK, EXECUTED, actor, at)


def escalate(alerts: DataFrame, matches: Column, actor: str, at: AsOf) -> DataFrame:
    return update_status(alerts, matches, ESCALATED, actor, at)


def dismiss(alerts: DataFrame, matches: Column, actor: str, at: AsOf) -> DataFrame:
    return update_status(alerts, matches, DISMISSED, actor, at)


def unexpired(alerts: DataFrame, as_of: AsOf) -> DataFrame:
    """Alerts still in force; what is left out is due for clean-up."""
    return alerts.where(F.col("expires_at") > as_timestamp(as_of).cast("timestamp_ntz"))


def mask_addresses(df: DataFrame, salt: str | None = None, column: str = "ip_address") -> DataFrame:
    """Hide addresses: a salted digest (still joins) or, without salt, no last octet."""
    if salt is not None:
        return df.withColumn(column, F.sha2(F.concat(F.col(column), F.lit(salt)), 256))
    return df.withColumn(column, F.regexp_replace(column, r"[^.:]+$", "xxx"))


def filtered(alerts: DataFrame, **equals: str | None) -> DataFrame:
    """Optional equality filters; ``None`` or "All" leaves a column alone."""
    wanted = {c: v for c, v in equals.items() if v not in (None, "All")}
    return reduce(lambda df, item: df.where(F.col(item[0]) == item[1]), wanted.items(), alerts)


def in_selection(
    alerts: DataFrame,
    since: AsOf,
    until: AsOf,
    risk_levels: tuple[str, ...] = ("CRITICAL", "HIGH"),
    actions: tuple[str, ...] = (BLOCK, REVIEW),
) -> DataFrame:
    """Date range (both ends included) and multi-select filters of the sidebar."""
    created = F.col("created_at").cast("date")
    return alerts.where(
        created.between(as_timestamp(since).cast("date"), as_timestamp(until).cast("date"))
        & F.col("risk_level").isin(*risk_levels)
        & F.col("final_action").isin(*actions)
    )
