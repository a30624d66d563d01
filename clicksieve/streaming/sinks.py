"""Running a stream into files or into an alert table."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from clicksieve.operators.alerts import actionable_alerts
from clicksieve.operators.scoring import risk_scores
from clicksieve.session import configure, work_folder
from clicksieve.sources import bid_logs
from clicksieve.sources.tables import Files

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
QUERY_ID = "sql.streaming.queryId"
FOLDERS = ("query_id", "batch_id")
WINDOW_DAY = "window_day"
STATE_STORE = "spark.sql.streaming.stateStore"
STATE_PROVIDER = f"{STATE_STORE}.providerClass"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Use the RocksDB store, so state is not limited by executor heap; its stores share one bound of memory per executor."""
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    spark.conf.set(f"{STATE_STORE}.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set(f"{STATE_STORE}.rocksdb.maxMemoryUsageMB", "500")


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A sibling session whose streams keep their state in so many partitions.

    The number is fixed by a stream's first run and AQE does not merge them,
    so it is chosen for the traffic the stream is to grow to, not for what
    there is at the start. Without one, the given session's setting holds.
    """
    session = configure(spark.newSession())
    keep_state_on_disk(session)
    session.conf.set(PARTITIONS, str(state_partitions or spark.conf.get(PARTITIONS)))
    return session


def to_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append results to a Parquet folder, exactly once per checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


class LateRows(RuntimeError):
    """A stream left rows out because they came after the watermark."""


class _LateCounter(StreamingQueryListener):
    """Late rows of each run of a query, over all of its batches; progress kept by the query itself is only the latest."""

    def __init__(self) -> None:
        self.late: Counter[str] = Counter()
        self.ended: defaultdict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.late[str(event.progress.runId)] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()


def finish(start: Callable[[], StreamingQuery], spark: SparkSession, what: str, allow_late: bool = False) -> StreamingQuery:
    """Starts a query, waits for its end and raises ``LateRows`` if any batch left rows out, unless ``allow_late``."""
    counter = _LateCounter()
    spark.streams.addListener(counter)
    try:
        query = start()
        query.awaitTermination()
        run = str(query.runId)
        # events come in order, but after the query itself has ended
        if not counter.ended[run].wait(timeout=120):
            raise RuntimeError(f"the end of {what} was not reported, so its late rows are not known")
    finally:
        spark.streams.removeListener(counter)
    if not allow_late and (late := counter.late[run]):
        raise LateRows(f"{late} rows of {what} came after the watermark")
    return query


def drain(
    stream: DataFrame, purpose: str, reader: SparkSession | None = None, allow_late: bool = False
) -> DataFrame:
    """Run over all input there is, wait, and read the result back (in ``reader``).

    Raises ``LateRows`` if rows came too late to be counted, unless ``allow_late``.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, purpose)
    finish(lambda: to_files(stream, f"{folder}/rows", f"{folder}/checkpoint"), spark, purpose, allow_late)
    return (reader or spark).read.schema(stream.schema).parquet(f"{folder}/rows")


def alerts_from_suspects(suspects: DataFrame) -> DataFrame:
    """Score and classify suspects of a window. Columns only, so it works in a stream.

    The window end is the clock of the alert.
    """
    scored = risk_scores(suspects, F.col("detected_at"))
    return actionable_alerts(scored, F.col("detected_at"))


def upsert_alerts(suspects: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Alerts of each micro-batch merged into ``path``, one row per address and window.

    The table is kept in folders by the day of the window. A batch reads and
    rewrites the days it has alerts of; all other files stay. Merging the same
    alerts again changes nothing, so a batch that is repeated after a failure,
    or a stream that starts over with a new checkpoint, leaves no second copy.
    Rewriting also keeps the number of files per day small. One stream at a
    time writes a table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # the batch is computed once: its plan holds the state of the stream
        aside = work_folder(batch.sparkSession, f"alerts-of-batch-{batch_id}")
        alerts_from_suspects(batch).write.parquet(aside)
        merge_alerts(batch.sparkSession.read.parquet(aside), path)

    writer = suspects.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def merge_alerts(fresh: DataFrame, path: str) -> list[date]:
    """Puts alerts into the table at ``path`` by (address, window); the days that were rewritten."""
    spark = fresh.sparkSession
    dated = fresh.withColumn(WINDOW_DAY, F.col("created_at").cast("date"))
    days = sorted(r[0] for r in dated.select(WINDOW_DAY).distinct().collect())
    if not days:
        return []
    there = set(Files(spark).partitions(path, WINDOW_DAY))
    if there & {str(d) for d in days}:
        stored = spark.read.schema(dated.schema).parquet(path).where(F.col(WINDOW_DAY).isin(days))
        dated = alerts_by_window(stored.unionByName(dated))
    else:
        dated = alerts_by_window(dated)
    # computed from the days that it replaces, so written aside first
    aside = work_folder(spark, "merged-alerts")
    dated.repartition(WINDOW_DAY).write.parquet(aside)
    merged = spark.read.schema(dated.schema).parquet(aside)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(WINDOW_DAY).parquet(path)
    spark.catalog.refreshByPath(path)
    return days


def alerts_by_window(alerts: DataFrame) -> DataFrame:
    """One alert per address and window; of several, the one that saw most clicks."""
    fullest = F.max_by(F.struct(*alerts.columns), F.struct("total_clicks", "alert_id"))
    return alerts.groupBy("ip_address", "created_at").agg(fullest.alias("a")).select("a.*")


def current_alerts(stored: DataFrame) -> DataFrame:
    """Latest alert of each address over all windows."""
    newest = F.max_by(F.struct(*stored.columns), F.struct("created_at", "total_clicks", "alert_id"))
    return stored.groupBy("ip_address").agg(newest.alias("a")).select("a.*")


def ingest_json(lines: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """JSON lines of a stream into ``path/logs`` and ``path/rejected``; every line is in one of them.

    Both are written per query and micro-batch into folders that are
    overwritten, so a repeated batch leaves no second copy and a stream with a
    new checkpoint overwrites nothing of an earlier one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)
        if not query_id:
            raise RuntimeError("lines are only taken in from within a running stream")
        # of a line that is taken, the typed columns are all that is kept
        rejected = F.when(F.col(bid_logs.REASON).isNotNull(), F.col(bid_logs.LINE)).alias(bid_logs.LINE)
        read = bid_logs.parsed_json(batch).select(rejected, bid_logs.REASON, *bid_logs.STORED.fieldNames()).persist()
        try:
            for name, rows in (("logs", bid_logs.typed_rows(read)), ("rejected", bid_logs.rejected_rows(read))):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/query_id={query_id}/batch_id={batch_id}")
        finally:
            read.unpersist()

    writer = lines.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def ingested(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``ingest_json`` has stored: (logs, rejected lines)."""
    logs, rejected = (
        spark.read.schema(shape).parquet(f"{path}/{name}").drop(*FOLDERS)
        for name, shape in (("logs", bid_logs.STORED), ("rejected", bid_logs.REJECTED))
    )
    return logs, rejected
