"""Velocity over a stream with state kept per shard of addresses and stretch of minutes.

The built-in chain in ``detect`` groups milliseconds and collects them when the
watermark closes a minute. Here ten minutes of a shard are a key with a state
of its own, a list of milliseconds with numbers of events, which every
micro-batch adds to, and a timer at the end. When the watermark passes it, the
stretch is reduced to one row per address, its state is cleared and the rows go to
the sliding windows. Python is called once per key and batch and works on whole
columns, so what an address costs there does not depend on how many keys a
sparse log has. An address has at most 600,000 entries in a key whatever the
traffic, and one that sends a third of all events is with a new key every ten
minutes, so it moves from task to task and none keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clicksieve.functions.columns import millis
from clicksieve.operators.velocity import flag_high_velocity
from clicksieve.rules import DETECTION, DetectionRules
from clicksieve.streaming.detect import EVENT_TIME, PANE_TIME, VELOCITY_PANE, over_panes
from clicksieve.streaming.panes import changes, packed, shard_of, unpacked

STRETCH_MS = 600_000
STRETCH_SHARDS = 8  # fixed by a stream's first run, like its state partitions
KEY = ["shard", "stretch"]
_PLACES = ["ip_address", "country_code", "device_type"]
_EVENTS = pa.schema([(c, pa.string()) for c in _PLACES] + [(c, pa.int64()) for c in ("at", "n", "last_us")])
_PANE_ROW = f"{PANE_TIME} timestamp, ip_address string, " + ", ".join(f"`{name}` {kind}" for name, kind in VELOCITY_PANE.items())


def _counted(events: pa.Table) -> pa.Table:
    """One row per address, place and millisecond."""
    keys = [*_PLACES, "at"]
    counts = events.group_by(keys, use_threads=False).aggregate([("n", "sum"), ("last_us", "max")])
    return counts.rename_columns([*keys, "n", "last_us"]).select(_EVENTS.names)


class _Stretches(StatefulProcessor):
    """Counts events per address and millisecond and reports a stretch of time once it is over."""

    def __init__(self, ultra_fast_ms: int, very_fast_ms: int):
        self.ultra_fast_ms, self.very_fast_ms = ultra_fast_ms, very_fast_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getListState("ticks", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # added without reading what is there: two calls to the state per key and batch
        parts = [pa.Table.from_pandas(part[_EVENTS.names], _EVENTS, preserve_index=False) for part in rows]
        self.ticks.appendValue((packed(_counted(pa.concat_tables(parts))),))
        self.handle.registerTimer((int(key[1]) + 1) * STRETCH_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = pa.concat_tables([unpacked(rows) for (rows,) in self.ticks.get()])
        self.ticks.clear()
        found = self._panes(events)
        found[PANE_TIME] = pd.Timestamp((int(key[1]) + 1) * STRETCH_MS * 1000 - 1, unit="us")
        yield found[[PANE_TIME, "ip_address", *VELOCITY_PANE]]

    def _panes(self, events: pa.Table) -> pd.DataFrame:
        ticks = events.group_by(["ip_address", "at"], use_threads=False).aggregate([("n", "sum"), ("last_us", "max")])
        ticks = ticks.sort_by([("ip_address", "ascending"), ("at", "ascending")]).combine_chunks()
        at, n = ticks.column("at").to_numpy(), ticks.column("n_sum").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], changes(ticks.column("ip_address"))]))
        ends = np.append(starts[1:], len(at)) - 1
        steps = np.diff(at, prepend=0)
        steps[starts] = STRETCH_MS  # no gap before the first; longer than any within
        each = lambda values: np.add.reduceat(values, starts)
        counted = each(n)
        repeats = counted - (ends - starts + 1)  # events beyond the first of a millisecond follow at a gap of zero
        following = np.minimum(starts + 1, ends)
        found = pd.DataFrame({
            "ip_address": ticks.column("ip_address").take(pa.array(starts)).to_pandas(),
            "start": at[starts], "end": at[ends], "second": np.where(n[starts] > 1, at[starts], at[following]), "events": counted,
            "fastest": np.where(repeats > 0, 0, np.minimum.reduceat(steps, starts)),
            "ultra": repeats + each((steps < self.ultra_fast_ms).astype(np.int64)),
            "very": repeats + each((steps < self.very_fast_ms).astype(np.int64)),
            "last_us": np.maximum.reduceat(ticks.column("last_us_max").to_numpy(), starts),
        })
        places = events.group_by("ip_address", use_threads=False).aggregate([("country_code", "min"), ("device_type", "min")])
        places = places.sort_by("ip_address")  # the same addresses in the same order
        for column in ("country_code", "device_type"):
            found[column] = places.column(f"{column}_min").to_pandas()
        return found

    def close(self) -> None:
        pass


def velocity_metrics(timed: DataFrame, rules: DetectionRules = DETECTION, slide: str = "1 hour") -> DataFrame:
    """The rows of ``detect.velocity_metrics``, from keyed state; see there for what they mean."""
    return over_panes(_stretches(timed, rules), rules, slide, keyed=True)


def _stretches(timed: DataFrame, rules: DetectionRules) -> DataFrame:
    at = millis(F.col("timestamp"))
    events = timed.where(F.col(EVENT_TIME).isNotNull()).select(
        EVENT_TIME, shard_of(F.col("ip_address"), STRETCH_SHARDS).alias("shard"), F.floor(at / STRETCH_MS).cast("long").alias("stretch"),
        *_PLACES, at.alias("at"), F.lit(1).cast("long").alias("n"), F.unix_micros(EVENT_TIME).alias("last_us"),
    )
    return events.groupBy(*KEY).transformWithStateInPandas(
        _Stretches(rules.ultra_fast_gap_ms, rules.very_fast_gap_ms), _PANE_ROW, "append", "EventTime", eventTimeColumnName=PANE_TIME,
    )


def high_velocity_suspects(timed: DataFrame, rules: DetectionRules = DETECTION, slide: str = "1 hour") -> DataFrame:
    return flag_high_velocity(over_panes(_stretches(timed, rules), rules, slide, keyed=True, suspects=True), rules)
