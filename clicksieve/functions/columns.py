"""Small column builders. All of them stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, TimestampType

AsOf = datetime | str | Column | None


def as_timestamp(moment: AsOf) -> Column:
    """The run's clock: a literal, a column, or the current time if not given.

    A literal keeps the trailing-window filter a constant comparison, which is
    what lets the Parquet reader skip row groups and partitions.
    """
    if moment is None:
        return F.current_timestamp()
    if isinstance(moment, Column):
        return moment.cast("timestamp")
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is not None:  # times at rest are UTC without a zone
        moment = moment.astimezone(timezone.utc)
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def hours_before(moment: AsOf, hours: int) -> Column:
    return as_timestamp(moment) - F.expr(f"INTERVAL {int(hours)} HOURS")


def days_before(moment: AsOf, days: int) -> Column:
    return as_timestamp(moment) - F.expr(f"INTERVAL {int(days)} DAYS")


def millis(ts: Column) -> Column:
    """Whole milliseconds since the epoch, rounded down.

    The difference of two such values counts millisecond boundaries crossed,
    which is how the gap between two clicks is defined here.
    """
    return F.unix_millis(ts.cast("timestamp"))


def tiered(value: Column, tiers: Iterable[tuple], otherwise, at_least: bool) -> Column:
    """First tier that holds, read from the top; ``otherwise`` if none does."""
    chain = None
    for bound, result in tiers:
        holds = value >= F.lit(bound) if at_least else value < F.lit(bound)
        chain = F.when(holds, F.lit(result)) if chain is None else chain.when(holds, F.lit(result))
    return chain.otherwise(F.lit(otherwise))


def lookup(key: Column, pairs: Iterable[tuple], otherwise) -> Column:
    """Value of the pair whose name equals ``key``; also for a NULL key ``otherwise``."""
    chain = None
    for name, result in pairs:
        hit = key == F.lit(name)
        chain = F.when(hit, F.lit(result)) if chain is None else chain.when(hit, F.lit(result))
    return chain.otherwise(F.lit(otherwise))


def flag_list(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


@dataclass(frozen=True)
class Verdict:
    """What a detector says of an address: whether it is caught, all flags, the strongest reason."""

    caught: Column
    flags: Column
    reason: Column

    def kept(self, metrics: DataFrame) -> DataFrame:
        return metrics.where(self.caught).withColumns({"fraud_flags": self.flags, "fraud_reason": self.reason})


def ratio(part: Column, whole: Column) -> Column:
    """Plain ratio as double; NULL, not an error, for an empty denominator."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """Unrounded percentage as double; NULL for an empty denominator."""
    return part.cast("double") * F.lit(100.0) / F.nullif(whole.cast("double"), F.lit(0.0))


def round2(value: Column) -> Column:
    """Two decimals, half up on the decimal value rather than the binary one."""
    return F.round(value.cast("decimal(38,12)"), 2).cast("double")


def exact_mean(value: Column) -> Column:
    """Mean of values with few decimals, independent of the summing order.

    Adding doubles in whatever order tasks finish changes the last bits from
    run to run. Scores are fractions with few digits, so they are summed as
    decimals and a rerun after a lost executor returns the same bytes.
    """
    total = F.sum(value.cast("decimal(15,9)")).cast("double")
    return total / F.nullif(F.count(value).cast("double"), F.lit(0.0))


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.lit(2.0) * a * b / F.nullif(a + b, F.lit(0.0))


def flatten_for_export(df: DataFrame) -> DataFrame:
    """Lists as comma-separated text and timestamps without a zone.

    For clients and files that have neither a list nor a zoned timestamp type.
    """
    out = []
    for column in df.schema.fields:
        value = F.col(column.name)
        if isinstance(column.dataType, ArrayType):
            value = F.array_join(value, ",")
        elif isinstance(column.dataType, TimestampType):
            value = value.cast("timestamp_ntz")
        out.append(value.alias(column.name))
    return df.select(*out)
