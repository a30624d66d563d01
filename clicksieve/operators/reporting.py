"""Queries behind the monitoring pages. Each is one grouped pass over alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicksieve.functions.columns import AsOf, as_timestamp, exact_mean, percent, round2
from clicksieve.rules import BLOCK, PENDING
from clicksieve.sources.inline import country_positions

LIST_COLUMNS = (
    "alert_id", "ip_address", "priority", "risk_score", "final_action", "action_status",
    "country_code", "total_clicks", "fastest_click_ms", "created_at",
)


def alert_kpis(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("priority") == "CRITICAL").alias("critical_alerts"),
        F.count_if(F.col("final_action") == BLOCK).alias("ips_blocked"),
        F.count_if(F.col("action_status") == PENDING).alias("pending_review"),
    )


def period_delta(alerts: DataFrame, as_of: AsOf, hours: int = 24) -> DataFrame:
    """Alerts of the latest period against the period before it, in percent.

    Only two periods are read: the lower bound is a plain comparison with a
    constant and reaches the scan.
    """
    now = as_timestamp(as_of)
    step = F.expr(f"INTERVAL {int(hours)} HOURS")
    middle, start = (now - step).cast("timestamp_ntz"), (now - step - step).cast("timestamp_ntz")
    created = F.col("created_at")
    critical = F.col("priority") == "CRITICAL"
    latest = created >= middle
    return (
        alerts.where((created >= start) & (created < now.cast("timestamp_ntz")))
        .agg(
            F.count_if(latest).alias("current_alerts"),
            F.count_if(~latest).alias("previous_alerts"),
            F.count_if(latest & critical).alias("current_critical"),
            F.count_if(~latest & critical).alias("previous_critical"),
        )
        .withColumns(
            {
                "alerts_change_percent": round2(
                    percent(F.col("current_alerts") - F.col("previous_alerts"), F.col("previous_alerts"))
                ),
                "critical_change_percent": round2(
                    percent(F.col("current_critical") - F.col("previous_critical"), F.col("previous_critical"))
                ),
            }
        )
    )


def alerts_by_day(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.to_date("created_at").alias("alert_date")).agg(
        F.count(F.lit(1)).alias("alert_count")
    ).orderBy("alert_date")


def avg_risk_by_day(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.to_date("created_at").alias("alert_date")).agg(
        exact_mean(F.col("risk_score")).alias("avg_risk_score")
    ).orderBy("alert_date")


def alerts_by_hour(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.hour("created_at").alias("hour_of_day")).agg(
        F.count(F.lit(1)).alias("alert_count")
    ).orderBy("hour_of_day")


def alerts_by_weekday(alerts: DataFrame) -> DataFrame:
    """Monday first; ``weekday`` 0 is Monday."""
    return alerts.groupBy(
        F.weekday("created_at").alias("weekday"),
        F.date_format("created_at", "EEEE").alias("day_of_week"),
    ).agg(F.count(F.lit(1)).alias("alert_count")).orderBy("weekday")


def distribution(alerts: DataFrame, column: str) -> DataFrame:
    """Alerts per value, most frequent first."""
    return alerts.groupBy(column).agg(F.count(F.lit(1)).alias("alert_count")).orderBy(
        F.desc("alert_count"), column
    )


def action_distribution(alerts: DataFrame) -> DataFrame:
    return distribution(alerts, "final_action")


def risk_level_distribution(alerts: DataFrame) -> DataFrame:
    return distribution(alerts, "risk_level")


def alerts_by_country(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("country_code").agg(F.count(F.lit(1)).alias("alert_count")).orderBy(
        "alert_count", "country_code"
    )


def avg_risk_by_country(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("country_code").agg(
        exact_mean(F.col("risk_score")).alias("avg_risk_score")
    ).orderBy(F.desc("avg_risk_score"), "country_code")


def _positioned(df: DataFrame) -> DataFrame:
    """Map position by country. The position table is fixed at eight rows, so it is broadcast."""
    positions = country_positions(df.sparkSession)
    return df.join(F.broadcast(positions), "country_code", "left").withColumns(
        {"lat": F.coalesce("lat", F.lit(0.0)), "lon": F.coalesce("lon", F.lit(0.0))}
    )


def geo_points(alerts: DataFrame) -> DataFrame:
    """One map point per alert."""
    return _positioned(alerts.select("alert_id", "country_code", "risk_level", "total_clicks"))


def geo_heatmap(alerts: DataFrame) -> DataFrame:
    """One map point per country and level: what a client can draw at any scale."""
    grouped = alerts.groupBy("country_code", "risk_level").agg(
        F.count(F.lit(1)).alias("alert_count"), F.sum("total_clicks").alias("total_clicks")
    )
    return _positioned(grouped)


def recent_critical_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    """The n newest critical alerts; the id breaks ties."""
    return (
        alerts.where(F.col("priority") == "CRITICAL")
        .select("alert_id", "ip_address", "risk_score", "final_action", "country_code", "created_at")
        .orderBy(F.desc("created_at"), "alert_id")
        .limit(n)
    )


def alert_list(alerts: DataFrame) -> DataFrame:
    return alerts.select(*LIST_COLUMNS)
