"""Bid-log ingest: Parquet and JSON, batch and streaming, and the stored layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clicksieve.functions.columns import AsOf, as_timestamp, hours_before
from clicksieve.rules import DETECTION, DetectionRules
from clicksieve.schemas import BID_LOGS

CORRUPT = "_corrupt_record"
EVENT_DATE = "event_date"


def _lenient(schema: StructType) -> StructType:
    """The same columns, all nullable, plus the place for unreadable lines."""
    out = StructType()
    for column in schema.fields:
        out = out.add(column.name, column.dataType, True)
    return out.add(CORRUPT, StringType(), True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.read.schema(BID_LOGS).parquet(path))


# The JSON writer cuts times to milliseconds unless told otherwise.
JSON_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines that ``read_json`` gives back unchanged."""
    df.write.option("timestampNTZFormat", JSON_TIME_FORMAT).json(path)


LINE, REASON = "line", "reason"
UNREADABLE = "unreadable"
STORED = StructType([StructField(c.name, c.dataType, True) for c in BID_LOGS.fields])
REJECTED = StructType([StructField(LINE, StringType()), StructField(REASON, StringType())])


def parsed_json(lines: DataFrame) -> DataFrame:
    """Lines of text (``value``) with what could be read of them, the line, and why it is rejected (null if it is not).

    Blank lines are no lines. Nothing is inferred. A line is rejected as a
    whole if any of its values cannot be read or a required column is missing.
    """
    # as a file source, JSON only checks the columns that a query happens to use
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("value", _lenient(BID_LOGS), options)
    raw = lines.where(F.length(F.trim("value")) > 0).select(F.col("value").alias(LINE), parsed.alias("_row")).select(LINE, "_row.*")
    missing = [F.when(F.col(c.name).isNull(), F.lit(c.name)) for c in BID_LOGS.fields if not c.nullable]
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit(UNREADABLE)).otherwise(
        F.nullif(F.concat_ws(", ", *missing), F.lit(""))
    )
    return raw.withColumn(REASON, reason)


def typed_rows(parsed: DataFrame) -> DataFrame:
    """The rows of ``parsed_json`` that are no rejects, in the layout of the logs."""
    return with_defaults(parsed.where(F.col(REASON).isNull()).select(*BID_LOGS.fieldNames()))


def rejected_rows(parsed: DataFrame) -> DataFrame:
    """Lines that were rejected, as they came, and why: unreadable, or the required columns that are missing."""
    return parsed.where(F.col(REASON).isNotNull()).select(LINE, REASON)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines with the fixed schema, as (typed rows, rejected rows); nothing is inferred or lost.

    Rejected rows have the typed columns, as far as they could be read, and the
    line in ``_corrupt_record``, which is null for a readable line without a
    required value.
    """
    parsed = parsed_json(spark.read.text(path))
    return typed_rows(parsed), parsed.where(F.col(REASON).isNotNull()).drop(LINE, REASON)


def json_lines(df: DataFrame, *others: Column) -> DataFrame:
    """Logs as JSON lines that ``parsed_json`` gives back unchanged, and ``others`` beside them."""
    return df.select(F.to_json(F.struct(*df.columns), {"timestampNTZFormat": JSON_TIME_FORMAT}).alias("value"), *others)


def read_lines_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of new files of a folder as a stream, for ``parsed_json``."""
    reader = spark.readStream
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.text(path)


def read_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """New files of a folder as a stream. Late defaults apply as in batch.

    Of JSON, lines that are no rows are left out here; ``ingest_json`` keeps them.
    """
    if fmt == "json":
        return typed_rows(parsed_json(read_lines_stream(spark, path, **options)))
    reader = spark.readStream.schema(BID_LOGS).format(fmt)
    for key, value in options.items():
        reader = reader.option(key, value)
    return with_defaults(reader.load(path))


def with_defaults(df: DataFrame) -> DataFrame:
    """Column defaults of the stored table: event type 'click'."""
    return df.withColumn("event_type", F.coalesce("event_type", F.lit("click")))


def stamped(df: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Fill ``processed_at`` for rows that arrive without one."""
    return df.withColumn(
        "processed_at",
        F.coalesce(F.col("processed_at"), as_timestamp(as_of).cast("timestamp_ntz")),
    )


def trailing_window(df: DataFrame, as_of: AsOf, rules: DetectionRules = DETECTION) -> DataFrame:
    """Rows of the last ``window_hours`` before ``as_of``; no upper bound.

    The bound is cast to the column's type rather than the other way round, so
    the comparison reaches the Parquet scan as a pushed filter. A table laid
    out by ``write_layout`` is also pruned by date.
    """
    since = hours_before(as_of, rules.window_hours)
    kept = df.where(F.col("timestamp") >= since.cast(df.schema["timestamp"].dataType))
    if EVENT_DATE in df.columns:
        kept = kept.where(F.col(EVENT_DATE) >= since.cast("date"))
    return kept


ROWS_PER_FILE = 20_000_000
ROWS_PER_TASK = 500_000  # what a writing task sorts


def writing_tasks(df: DataFrame, at_least: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """How many tasks write ``df``: as many as asked for, and more where they would have more rows than a task sorts."""
    return max(at_least, -(-df.count() // rows_per_task))


def write_layout(df: DataFrame, path: str, files: int, rows_per_file: int = ROWS_PER_FILE, mode: str = "overwrite") -> None:
    """Store logs by date, clustered on address and time inside each date.

    Range partitioning on (date, address, time) cuts a hot address into several
    files along its time axis. Hash partitioning or bucketing by address would
    put all its rows into one task and one file. Clustered files also make the
    detectors cheaper: the map-side halves of their aggregations see each
    address in few tasks. ``files`` is how many tasks write at least; larger
    logs get one per ``ROWS_PER_TASK`` rows, which are counted first. None
    writes a file of more than ``rows_per_file``.
    """
    dated = df.withColumn(EVENT_DATE, F.col("timestamp").cast("date"))
    order = [EVENT_DATE, "ip_address", "timestamp"]
    ranged = dated.repartitionByRange(writing_tasks(df.select("timestamp"), files), *order).sortWithinPartitions(*order)
    writer = ranged.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy(EVENT_DATE).parquet(path)
