"""Both detectors from one scan and one exchange of raw rows.

Apart, each detector reads and shuffles the logs for itself. Here raw rows are
dealt once by (minute, address), where the gaps between neighbouring events are
taken. Each row then gives one gap row and, where a value differs from that of
the event before it, one presence row per counted column. Both kinds are summed
up in the same place before they travel on: gap rows by address, as in the
velocity detector, and presence rows by (address, value), so that an address
with very many values is spread over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicksieve.functions.columns import AsOf, millis
from clicksieve.operators.suspects import combined_row, finish_suspects, merge_suspects
from clicksieve.operators.velocity import (
    ADDRESS,
    SLICE_SECONDS,
    gap_statistics,
    gap_sums,
    slice_of,
    velocity_verdict,
)
from clicksieve.operators.volume import COUNTED, volume_verdict
from clicksieve.rules import DETECTION, DetectionRules

GAPS = 0  # kind of a gap row; the counted columns follow from 1


def _reduced(logs: DataFrame, keys: Sequence[str], slice_seconds: int) -> DataFrame:
    """Gap and presence rows, one per (slice, address) and what they tell apart.

    What a row does not need stays null, as it costs most of what travels on: a
    presence row has neither slice nor count nor times, and of the gap rows of
    a slice only those of its first two events have ``first_ts`` and only that
    of its last has ``last_ts``. No other event can be the first or last of its
    address, the first with a gap or the neighbour of another slice.
    """
    by_slice = ["_slice", *keys]
    in_slice = Window.partitionBy(*by_slice).orderBy("timestamp")
    counted = list(COUNTED)
    rows = logs.select(*keys, "timestamp", "country_code", "device_type", *counted, slice_of(logs, slice_seconds).alias("_slice"))
    rows = rows.withColumns(
        {
            "_gap": millis(F.col("timestamp")) - millis(F.lag("timestamp").over(in_slice)),
            "_early": F.when(F.row_number().over(in_slice) <= 2, F.col("timestamp")),
            "_late": F.when(F.lead(F.lit(True)).over(in_slice).isNull(), F.col("timestamp")),
        }
        | {f"_same_{c}": F.col(c).eqNullSafe(F.lag(c).over(in_slice)) for c in counted}
    )
    nothing = F.lit(None).cast("string")

    def row(kind: int, gap: Column, value: Column, country: Column, device: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), gap.alias("gap_ms"), value.alias("value"), country.alias("country_code"), device.alias("device_type")
        )

    gaps = row(GAPS, F.col("_gap"), nothing, F.col("country_code"), F.col("device_type"))
    values = [
        F.when(F.col(c).isNotNull() & ~F.col(f"_same_{c}"), row(i, F.lit(None).cast("bigint"), F.col(c), nothing, nothing))
        for i, c in enumerate(counted, GAPS + 1)
    ]
    told_apart = rows.select(*by_slice, "_early", "_late", F.inline(F.array_compact(F.array(gaps, *values))))
    summed = told_apart.groupBy(*by_slice, "kind", "gap_ms", "value", "country_code", "device_type").agg(
        F.count(F.lit(1)).alias("clicks"), F.min("_early").alias("first_ts"), F.max("_late").alias("last_ts")
    )
    of_gaps = {name: F.when(F.col("kind") == GAPS, F.col(name)) for name in ("_slice", "clicks", "first_ts", "last_ts")}
    return summed.withColumns(of_gaps)


def detector_metrics(
    logs: DataFrame, keys: Sequence[str] = ADDRESS, rules: DetectionRules = DETECTION, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Keys and the metrics of both detectors, as structs ``volume`` and ``velocity``.

    The same rows as ``volume_metrics`` and ``velocity_metrics``; ``velocity``
    is null for an address with a single event. Per address the middle step
    handles what the clock bounds, see ``velocity``; presence rows are spread.
    """
    spread = Window.partitionBy(*keys, "kind", "value").orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    is_gap = F.col("kind") == GAPS
    between = millis(F.col("first_ts")) - millis(F.max("last_ts").over(spread))
    placed = _reduced(logs, keys, slice_seconds).withColumn("gap_ms", F.when(is_gap, F.coalesce("gap_ms", between)))
    # the first event of an address has no gap and is the volume detector's alone
    followed = F.col("gap_ms").isNotNull()
    sums = {
        "total_events": F.sum(F.when(is_gap, F.col("clicks"))),
        "volume_country": F.min("country_code"),
        "volume_device": F.min("device_type"),
        "volume_first": F.min(F.when(is_gap, F.col("first_ts"))),
        "volume_last": F.max(F.when(is_gap, F.col("last_ts"))),
    } | gap_sums(rules, followed)
    per_value = placed.groupBy(*keys, "kind", "value").agg(*[c.alias(name) for name, c in sums.items()])
    # one gap row per address is left and one row per value
    grouped = per_value.groupBy(*keys).agg(
        *[F.max(name).alias(name) for name in sums],
        *[F.count_if(F.col("kind") == i).alias(name) for i, name in enumerate(COUNTED.values(), GAPS + 1)],
    )
    volume = F.struct(
        "total_events", *COUNTED.values(),
        F.col("volume_first").alias("first_seen"), F.col("volume_last").alias("last_seen"),
        F.col("volume_country").alias("country_code"), F.col("volume_device").alias("device_type"),
    )
    velocity = F.when(F.col("total_clicks").isNotNull(), F.struct(*[c.alias(name) for name, c in gap_statistics().items()]))
    return grouped.select(*keys, volume.alias("volume"), velocity.alias("velocity"))


def volume_metrics(metrics: DataFrame, keys: Sequence[str] = ADDRESS) -> DataFrame:
    return metrics.select(*keys, "volume.*")


def velocity_metrics(metrics: DataFrame, keys: Sequence[str] = ADDRESS) -> DataFrame:
    return metrics.where(F.col("velocity").isNotNull()).select(*keys, "velocity.*")


def detector_rows(rules: DetectionRules = DETECTION) -> dict[str, Column]:
    """Each detector's row for the metrics ``volume`` and ``velocity``; null where it does not catch the address."""
    volume, velocity = F.col("volume"), F.col("velocity")
    by_volume, by_velocity = volume_verdict(volume.getField, rules), velocity_verdict(velocity.getField, rules)
    return {
        "volume": F.when(by_volume.caught, combined_row("HIGH_VOLUME", volume.getField, by_volume)),
        "velocity": F.when(by_velocity.caught, combined_row("HIGH_VELOCITY", velocity.getField, by_velocity)),
    }


def combined_suspects(metrics: DataFrame, keys: Sequence[str] = ADDRESS, rules: DetectionRules = DETECTION) -> DataFrame:
    """What ``combine_detectors`` gives: a row per detector that caught the address.

    Both rows come from one, so the address stays where it is.
    """
    return metrics.select(*keys, F.inline(F.array_compact(F.array(*detector_rows(rules).values()))))


def suspect_ips(
    logs: DataFrame, detected_at: AsOf, rules: DetectionRules = DETECTION, keys: Sequence[str] = ADDRESS
) -> DataFrame:
    """Logs to suspects in one plan with one scan and one exchange of raw rows."""
    combined = combined_suspects(detector_metrics(logs, keys, rules), keys, rules)
    return finish_suspects(merge_suspects(combined, keys), detected_at, rules)
