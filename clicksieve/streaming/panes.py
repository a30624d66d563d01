"""Sliding windows put together from panes, without a row of state per window.

A built-in sliding window keeps a row for every window and address, 24 for an
event that stands alone in its day. Here each address keeps its panes (rows of
an hour or less) once, for as long as a window to come needs them. Addresses are
dealt to shards; the panes of a shard are one value of state, and when the
watermark passes an hour, the panes of the windows that are over go out as one row
per address and day of windows. Windows are cut from these rows by column
expressions.

The length of a pane list is bounded by the clock, as panes are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHARDS = 1024  # fixed by a stream's first run, like its state partitions; a worker holds the panes of one at a time
PART = 20_000  # panes that are listed and given out at once
HOUR_MS = 3_600_000
BEFORE_ALL = -(1 << 40)
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
# panes in lists, the number of the list of each and how many lists there are, to whether a list is wanted
Told = Callable[[pa.Table, np.ndarray, int], np.ndarray]
_PACKED = pa.ipc.IpcWriteOptions(compression="lz4")


def shard_of(address: Column, shards: int) -> Column:
    return F.pmod(F.hash(address), F.lit(shards))


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_PACKED) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before; nulls are equal."""
    values = column.to_numpy()
    return values[1:] != values[:-1]


def numbered(starts: np.ndarray, rows: int) -> np.ndarray:
    """The number of each row's list, where lists begin at ``starts``."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows)))


def _lists(panes: pa.Table, done: int, over: int, per_window: int, told: Told | None) -> pd.DataFrame:
    """Panes listed per address and block of ``per_window`` windows: those that end after ``done`` and up to ``over``."""
    at = panes.column("at").to_numpy()
    block = (at - 1) // per_window
    # the windows of a pane end in its own block or in the next
    both = pa.concat_tables([panes.append_column("block", pa.array(block)), panes.append_column("block", pa.array(block + 1))])
    both = both.sort_by([(c, "ascending") for c in ("ip_address", "block", "at", "order")]).combine_chunks()
    starts = np.flatnonzero(np.concatenate([[True], changes(both.column("ip_address")) | changes(both.column("block"))]))
    ends = np.append(starts[1:], both.num_rows)
    blocks, at = both.column("block").to_numpy()[starts], both.column("at").to_numpy()
    first = np.maximum(np.maximum(at[starts], blocks * per_window + 1), done + 1)
    last = np.minimum(np.minimum(at[ends - 1] + per_window - 1, (blocks + 1) * per_window), over)
    listed = {"ip_address": both.column("ip_address").take(pa.array(starts)), "first": pa.array(first), "last": pa.array(last)}
    offsets = pa.array(np.append(starts, both.num_rows).astype(np.int32))
    for name in panes.column_names[1:]:
        values = both.column(name).combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        listed[f"{name}s"] = pa.ListArray.from_arrays(offsets, values)
    wanted = first <= last if told is None else (first <= last) & told(both, numbered(starts, both.num_rows), len(starts))
    return pa.table(listed).filter(pa.array(wanted)).to_pandas()


def _in_parts(panes: pa.Table, most: int = PART) -> Iterator[pa.Table]:
    """Panes in parts of whole addresses, about ``most`` in each; more where one address has them."""
    panes = panes.sort_by("ip_address").combine_chunks()
    starts = np.flatnonzero(np.concatenate([[True], changes(panes.column("ip_address"))]))
    cuts = starts[np.flatnonzero(np.diff(starts // most, prepend=-1))]
    for start, end in zip(cuts, np.append(cuts[1:], panes.num_rows)):
        yield panes.slice(start, end - start)


def _given_out(panes: pa.Table, done: int, over: int, per_window: int, told: Told | None = None) -> tuple[pd.DataFrame | None, pa.Table, int]:
    """Lists of the windows that end after ``done`` and up to ``over``, and the panes that windows to come need."""
    at, lists = panes.column("at").to_numpy(), None
    if over > done:
        if (at <= over).any():
            lists = _lists(panes.filter(pa.array(at <= over)), done, over, per_window, told)
        done = over
    return lists, panes.filter(pa.array(at + per_window - 1 > done)), done


def _due(panes: pa.Table, done: int, slide_ms: int) -> int:
    """The last millisecond before the next window that is not empty ends."""
    return max(int(panes.column("at").to_numpy().min()), done + 1) * slide_ms - 1


class _Kept(StatefulProcessor):
    """Panes of a shard, for streams in which they come from an aggregation."""

    def __init__(self, schema: pa.Schema, per_window: int, slide_ms: int, told: Told | None):
        self.schema, self.per_window, self.slide_ms, self.told = schema, per_window, slide_ms, told

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getListState("panes", "panes binary, done long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added = [_table(part, self.schema) for part in rows]
        self.panes.appendList([(packed(panes), BEFORE_ALL) for panes in added])
        self.handle.registerTimer(min(_due(panes, BEFORE_ALL, self.slide_ms) for panes in added))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = list(self.panes.get())
        if not rows:
            return
        over, done = timerValues.getCurrentWatermarkInMs() // self.slide_ms, max(r[1] for r in rows)
        if over == done:
            return  # another timer of this batch came first
        kept = []
        for part in _in_parts(pa.concat_tables([unpacked(r[0]) for r in rows])):
            lists, left, _ = _given_out(part, done, over, self.per_window, self.told)
            kept.append(left)
            if lists is not None:
                yield lists
        kept, done = pa.concat_tables(kept), max(done, over)
        self.panes.clear()
        if kept.num_rows:
            self.panes.put([(packed(kept), done)])
            self.handle.registerTimer(_due(kept, done, self.slide_ms))

    def close(self) -> None:
        pass


def _keep(schema: pa.Schema, per_window: int, slide_ms: int, told: Told | None):
    """The same for streams in which panes come from keyed state."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, done = state.get if state.exists else (None, BEFORE_ALL)
        tables = [unpacked(rows)] if rows else []
        panes = pa.concat_tables(tables + [_table(part, schema) for part in parts if len(part)])
        over, kept = state.getCurrentWatermarkMs() // slide_ms, []
        for part in _in_parts(panes):
            lists, left, _ = _given_out(part, done, over, per_window, told)
            kept.append(left)
            if lists is not None:
                yield lists
        kept, done = pa.concat_tables(kept), max(done, over)
        if kept.num_rows:
            state.update((packed(kept), done))
            state.setTimeoutTimestamp(max(_due(kept, done, slide_ms), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return run


def _table(part: pd.DataFrame, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pandas(part[schema.names], schema, preserve_index=False)


def sliding(
    rows: DataFrame, time: str, fields: dict[str, str], order: str, hours: int, slide: str = "1 hour", keyed: bool = False,
    shards: int = SHARDS, told: Told | None = None,
) -> DataFrame:
    """window, ip_address and ``panes``, the window's rows in the order of the field ``order``.

    ``time`` is the event time of a row, which with its watermark tells the slide that
    it belongs to; ``fields`` are its columns with their types. A window is
    given out once, when the watermark passes its end. ``keyed`` says that ``rows``
    come from keyed state and from no aggregation. ``told`` says which lists have
    a window that is asked for, or may have one; no windows are cut from the others.
    """
    slide_ms = int(pd.Timedelta(slide).total_seconds() * 1000)
    if hours * HOUR_MS % slide_ms:
        raise ValueError(f"a window of {hours} hours is no multiple of {slide}")
    per_window = hours * HOUR_MS // slide_ms
    schema = pa.schema([("ip_address", pa.string()), ("at", pa.int64()), ("order", pa.int64())] + [(n, _ARROW[t]) for n, t in fields.items()])
    at = F.floor(F.unix_millis(time) / slide_ms).cast("long") + 1
    dealt = rows.select(
        shard_of(F.col("ip_address"), shards).alias("shard"), time, "ip_address", at.alias("at"), F.col(order).cast("long").alias("order"), *fields
    )
    lists = {"at": "long", "order": "long", **fields}
    shape = "ip_address string, first long, last long, " + ", ".join(f"`{n}s` array<{t}>" for n, t in lists.items())
    by_shard = dealt.groupBy("shard")
    if keyed:
        keep, kept = _keep(schema, per_window, slide_ms, told), "panes binary, done long"
        listed = by_shard.applyInPandasWithState(keep, shape, kept, "append", GroupStateTimeout.EventTimeTimeout)
    else:
        listed = by_shard.transformWithStateInPandas(_Kept(schema, per_window, slide_ms, told), shape, "append", "EventTime")
    panes = F.arrays_zip(*(F.col(f"{n}s").alias(n) for n in lists))

    def window(end: Column) -> Column:
        within = F.filter(F.col("panes"), lambda p: (p["at"] <= end) & (p["at"] > end - per_window))
        return F.struct(end.alias("end"), within.alias("panes"))

    windows = listed.select("ip_address", "first", "last", panes.alias("panes")).select(
        "ip_address", F.inline(F.transform(F.sequence("first", "last"), window))
    )
    moment = lambda slides: F.timestamp_millis(slides * slide_ms)
    return windows.where(F.size("panes") > 0).select(
        F.struct(moment(F.col("end") - per_window).alias("start"), moment(F.col("end")).alias("end")).alias("window"), "ip_address", "panes"
    )
