"""The kept alert table: filled day by day, worked on in place, cleaned up.

    folder/alerts/event_day=...       one folder per day with alerts
    folder/days                       which days have been processed
    folder/changes/change_id=.../event_day=...   status changes not folded in yet

Only days that have not been processed are read from the logs, so a daily run
costs one day however long the history is, and the monitoring pages read this
table and no logs. Analysts' status changes are appended and never rewrite
alerts while somebody waits; ``current`` shows them at once, ``fold`` writes
them into the days they touch and leaves all other files alone.

Every step may run again after a failure: a day is overwritten as a whole, a
change is written under its own id, and a change that was folded twice says the
same. One writer at a time is assumed for ``fold`` and ``expire``.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from clicksieve.functions.columns import AsOf, as_timestamp
from clicksieve.operators.alerts import unexpired
from clicksieve.plans.jobs import alert_history
from clicksieve.rules import ACTIONS, DETECTION, PENDING, ActionRules, DetectionRules
from clicksieve.schemas import BID_LOGS
from clicksieve.sources.bid_logs import EVENT_DATE
from clicksieve.sources.tables import Files

DAY = "event_day"
STATUS = ("action_status", "actioned_by", "actioned_at")


class AlertStore:
    """The alert table under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.alerts_path, self.days_path, self.changes_path = (f"{self.folder}/{n}" for n in ("alerts", "days", "changes"))
        self.files = Files(spark)

    # filling ---------------------------------------------------------------------

    def processed(self) -> set[date]:
        if not self.files.exists(self.days_path):
            return set()
        return {r[DAY] for r in self.spark.read.parquet(self.days_path).select(DAY).distinct().collect()}

    def backfill(self, layout: str, again: set[date] | None = None, rules: DetectionRules = DETECTION) -> list[date]:
        """Alerts of the days of a stored layout that have none yet; the days in ``again`` are done anew.

        Days come from the names of the layout's folders, not from its rows. The
        list of processed days is written last: what fails before is repeated.
        """
        there = {date.fromisoformat(v) for v in self.files.partitions(layout, EVENT_DATE)}
        new = sorted(there - self.processed() | (there & (again or set())))
        if not new:
            return []
        logs = self.spark.read.parquet(layout).where(F.col(EVENT_DATE).isin(new))
        found = alert_history(logs.drop(EVENT_DATE), rules)
        for day in again or ():  # a day without alerts now has no folder to overwrite the old one with
            self.files.delete(f"{self.alerts_path}/{DAY}={day}")
        self._overwrite(found.withColumn(DAY, F.col("created_at").cast("date")))
        self.spark.createDataFrame([(d,) for d in new], f"{DAY} date").coalesce(1).write.mode("append").parquet(self.days_path)
        return new

    def _overwrite(self, alerts: DataFrame) -> None:
        """Replaces the days that ``alerts`` has rows of, and no others."""
        # a day goes to few tasks, so its folder has few files
        dealt = alerts.repartition(DAY) if DAY in alerts.columns else alerts
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.alerts_path)

    def stored(self) -> DataFrame:
        """Alerts as they were last folded, with ``event_day``; no rows before the first day and after the last has gone."""
        if not self.files.partitions(self.alerts_path, DAY):
            return self.spark.createDataFrame([], self._shape)
        return self.spark.read.schema(self._shape).parquet(self.alerts_path)

    @cached_property
    def _shape(self) -> StructType:
        return alert_history(self.spark.createDataFrame([], BID_LOGS)).schema.add(DAY, DateType())

    # working -----------------------------------------------------------------------

    def change(
        self, change_id: str, matches: Column, status: str, actor: str, at: AsOf, only_from: tuple[str, ...] = (PENDING,)
    ) -> int:
        """Records a status for all alerts that match and are in one of the states ``only_from``; how many.

        Nothing is rewritten. The same ``change_id`` again replaces its own record.
        """
        before = self.current(without=change_id)
        hit = before.where(F.coalesce(matches, F.lit(False)) & F.col("action_status").isin(*only_from))
        rows = hit.select(
            "alert_id", F.lit(status).alias("action_status"), F.lit(actor).alias("actioned_by"),
            as_timestamp(at).cast("timestamp_ntz").alias("actioned_at"), DAY,
        )
        target = f"{self.changes_path}/change_id={change_id}"
        rows.write.mode("overwrite").partitionBy(DAY).parquet(target)
        return self.spark.read.schema(rows.schema).parquet(target).count()

    def _changes(self, without: str | None = None) -> DataFrame | None:
        ids = [i for i in self.files.partitions(self.changes_path, "change_id") if i != without]
        if not ids:
            return None
        shape = f"alert_id string, action_status string, actioned_by string, actioned_at timestamp_ntz, change_id string, {DAY} date"
        return self.spark.read.schema(shape).parquet(self.changes_path).where(F.col("change_id").isin(ids))

    def current(self, without: str | None = None) -> DataFrame:
        """Alerts with the latest recorded status; of changes at one time, the one with the greatest id."""
        return self._applied(self.stored(), self._changes(without))

    @staticmethod
    def _applied(alerts: DataFrame, changes: DataFrame | None) -> DataFrame:
        if changes is None:
            return alerts
        latest = changes.groupBy(DAY, "alert_id").agg(
            F.max_by(F.struct(*STATUS), F.struct("actioned_at", "change_id")).alias("_change")
        )
        joined = alerts.join(latest, [DAY, "alert_id"], "left")
        changed = F.col("_change").isNotNull()
        new = {c: F.when(changed, F.col(f"_change.{c}")).otherwise(F.col(c)) for c in STATUS}
        return joined.withColumns(new).select(*alerts.columns)

    def fold(self) -> list[date]:
        """Writes recorded changes into the days they touch, which it returns, and forgets the records."""
        changes = self._changes()
        if changes is None:
            return []
        folded = self.files.partitions(self.changes_path, "change_id")
        touched = sorted(r[DAY] for r in changes.select(DAY).distinct().collect())
        if touched:
            old = self.stored().where(F.col(DAY).isin(touched))
            self._rewritten(self._applied(old, changes), touched)
        for change_id in folded:
            self.files.delete(f"{self.changes_path}/change_id={change_id}")
        return touched

    def _rewritten(self, rows: DataFrame, days: list[date]) -> None:
        """New rows of some days, computed from the same days: written aside first."""
        aside = f"{self.folder}/aside"
        rows.write.mode("overwrite").parquet(aside)
        fresh = self.spark.read.schema(rows.schema).parquet(aside)
        left = {r[DAY] for r in fresh.select(DAY).distinct().collect()}
        self._overwrite(fresh)
        for day in set(days) - left:
            self.files.delete(f"{self.alerts_path}/{DAY}={day}")
        self.files.delete(aside)
        self.spark.catalog.refreshByPath(self.alerts_path)

    # cleaning up ---------------------------------------------------------------------

    def expire(self, as_of: AsOf, rules: ActionRules = ACTIONS) -> tuple[list[date], list[date]]:
        """Removes alerts that are no longer in force: (days dropped whole, days rewritten).

        A day's alerts are all over once the longest term has passed since its
        end; such folders go unread. Only the few days since are looked into.
        Changes are folded first.
        """
        self.fold()
        longest = max(days for _, days in rules.expiry_days + (("", rules.expiry_days_otherwise),))
        oldest = self.spark.range(1).select(
            (as_timestamp(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(longest + 1))).cast("date")
        ).first()[0]
        there = [date.fromisoformat(v) for v in self.files.partitions(self.alerts_path, DAY)]
        dropped = sorted(d for d in there if d < oldest)
        for day in dropped:
            self.files.delete(f"{self.alerts_path}/{DAY}={day}")
        recent = self.stored().where(F.col(DAY) >= F.lit(oldest))
        over = recent.where(F.col("expires_at") <= as_timestamp(as_of).cast("timestamp_ntz"))
        rewritten = sorted(r[DAY] for r in over.select(DAY).distinct().collect())
        if rewritten:
            self._rewritten(unexpired(recent.where(F.col(DAY).isin(rewritten)), as_of), rewritten)
        return dropped, rewritten
