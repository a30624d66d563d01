"""What the text operators share: table access, staged tables, text columns."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder

ROW = "_row"
_TABLE: dict = {}


def worker_table(name, make: Callable[[], dict]) -> dict:
    """A table of words that is kept while a Python worker lives, until it is asked for another one.

    Workers outlive a stage, so tables of several operators would add up.
    """
    if name not in _TABLE:
        _TABLE.clear()
        _TABLE[name] = make()
    return _TABLE[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Cuts the lineage, so that later steps and lost executors reread a file
    instead of computing everything before it again.
    """
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame) -> DataFrame:
    """A number for each row, for use inside one job whose result is staged.

    Rows that share an id, or have none, stay apart by it.
    """
    return df.withColumn(ROW, F.monotonically_increasing_id())


def whole(text: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


# Upper-case letters beyond A-Z, and what this JVM's tables do not know: where there is none, lower() changes A-Z only.
OTHER_UPPER_CASE = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    letters = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike(OTHER_UPPER_CASE), letters).otherwise(F.lower(text))
