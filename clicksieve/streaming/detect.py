"""Detectors over an event-time stream, from built-in aggregations only.

No operator here keeps a list whose length depends on the traffic. Each chain
first reduces events to clock ticks (milliseconds, minutes or hours) with
map-side combine, and only ticks are collected: an address that sends a third
of all events has no more ticks per minute than any other.

Results are emitted once, when the watermark passes the end of their window.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicksieve.functions.columns import millis
from clicksieve.operators.fused import detector_rows
from clicksieve.operators.suspects import finish_suspects, merged_row
from clicksieve.operators.velocity import flag_high_velocity
from clicksieve.operators.volume import flag_high_volume
from clicksieve.rules import DETECTION, DetectionRules
from clicksieve.streaming import panes

EVENT_TIME = "event_time"
WINDOW_KEYS = ("window", "ip_address")
PANE_TIME = "pane_time"
MINUTE_MS = 60_000
MARK_BITS = 46  # with a millisecond of a minute they fit a long; two events have the same mark once in 10^13
MARK = (1 << MARK_BITS) - 1
COUNTED = {"user_agent": "uas", "campaign_id": "campaigns", "publisher_id": "publishers"}
_SEEN = {"country_code": "string", "device_type": "string", "last_us": "long"}
VOLUME_PANE = {"events": "long", **dict.fromkeys(COUNTED.values(), "binary"), "first_us": "long", **_SEEN}
VELOCITY_PANE = {**dict.fromkeys(("start", "end", "second", "events", "fastest", "ultra", "very"), "long"), **_SEEN}


def with_event_time(logs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Zoned event time and how late an event may be. Later ones are dropped."""
    return logs.withColumn(EVENT_TIME, F.col("timestamp").cast("timestamp")).withWatermark(EVENT_TIME, delay)


def dedup(logs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First event of each bid request id; ids are forgotten after the delay."""
    return with_event_time(logs, delay).dropDuplicatesWithinWatermark(["bid_request_id"])


def _micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def _moment(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def _each(rows: Column, field: str) -> Column:
    return F.transform(rows, lambda row: row[field])


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def volume_panes(timed: DataFrame, slide: str = "1 hour", sketch_bits: int = 14) -> DataFrame:
    """An hour (``slide``) of an address as a row, given out when it is over."""
    hourly = timed.groupBy(F.window(EVENT_TIME, slide), "ip_address").agg(
        F.count(F.lit(1)).alias("events"),
        *[F.hll_sketch_agg(column, sketch_bits).alias(name) for column, name in COUNTED.items()],
        _micros(F.min("timestamp")).alias("first_us"),
        _micros(F.max("timestamp")).alias("last_us"),
        F.min("country_code").alias("country_code"),
        F.min("device_type").alias("device_type"),
    )
    return hourly.withColumn(PANE_TIME, F.window_time("window")).drop("window")


def _volume_of(rows: Column) -> dict[str, Column]:
    """Volume metrics of a window from its panes."""

    def estimate(name: str) -> Column:
        sketches = _each(rows, name)
        union = F.aggregate(F.slice(sketches, F.lit(2), F.size(sketches)), F.get(sketches, F.lit(0)), lambda a, b: F.hll_union(a, b))
        return F.hll_sketch_estimate(union)

    return {
        "total_events": _total(_each(rows, "events")),
        "distinct_uas": estimate("uas"),
        "distinct_campaigns": estimate("campaigns"),
        "distinct_publishers": estimate("publishers"),
        "first_seen": _moment(F.array_min(_each(rows, "first_us"))),
        "last_seen": _moment(F.array_max(_each(rows, "last_us"))),
        "country_code": F.array_min(_each(rows, "country_code")),
        "device_type": F.array_min(_each(rows, "device_type")),
    }


def volume_metrics(
    timed: DataFrame, rules: DetectionRules = DETECTION, slide: str = "1 hour", sketch_bits: int = 14
) -> DataFrame:
    """Volume metrics per sliding window and address.

    A stream cannot count distinct values exactly, so agents, campaigns and
    publishers are sketched (about 0.8 % error at 14 bits; small counts are
    exact). Events are reduced to one row per hour first, and windows are put
    together from these (``panes``).
    """
    hourly = volume_panes(timed, slide, sketch_bits)
    windows = panes.sliding(hourly, PANE_TIME, VOLUME_PANE, "first_us", rules.window_hours, slide)
    return windows.select(*WINDOW_KEYS, *_named(_volume_of(F.col("panes"))))


def _steps(sorted_ticks: Column, start: str, end: str) -> Column:
    """Distances from the end of one tick to the start of the next."""
    following = F.slice(sorted_ticks, F.lit(2), F.greatest(F.size(sorted_ticks) - 1, F.lit(0)))
    leading = F.slice(sorted_ticks, F.lit(1), F.greatest(F.size(sorted_ticks) - 1, F.lit(0)))
    return F.zip_with(leading, following, lambda a, b: b[start] - a[end])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, v: total + v)


def _below(steps: Column, bound: int) -> Column:
    return F.size(F.filter(steps, lambda s: s < bound)).cast("bigint")


def velocity_panes(timed: DataFrame, rules: DetectionRules = DETECTION) -> DataFrame:
    """A minute of an address as a row with the fields ``VELOCITY_PANE``, given out when it is over.

    These are the first, last and second event's millisecond, how many events,
    the least gap, how many gaps are below the two bounds of the rules, and
    what else a window is told by. Events may arrive in any order until the
    watermark passes; gaps are taken from the sorted milliseconds (at most
    60,000), so they are never negative.
    """
    at = millis(F.col("timestamp"))
    tick = F.pmod(at, F.lit(MINUTE_MS)).cast("int")
    # a random mark tells whether the first millisecond has several events: then least and greatest differ
    marked = timed.withColumn("_tick", tick).withColumn("_mark", (F.rand() * (1 << MARK_BITS)).cast("long"))
    low, high = (F.shiftleft(F.col("_tick").cast("long"), MARK_BITS) + mark for mark in (F.col("_mark"), F.lit(MARK) - F.col("_mark")))
    minutes = marked.groupBy(F.window(EVENT_TIME, "1 minute"), "ip_address").agg(
        F.count(F.lit(1)).alias("events"),
        F.sort_array(F.collect_set("_tick")).alias("_ticks"),
        F.min(low).alias("_low"),
        F.min(high).alias("_high"),
        _micros(F.max("timestamp")).alias("last_us"),
        F.min("country_code").alias("country_code"),
        F.min("device_type").alias("device_type"),
    )
    tied = F.col("_low").bitwiseAND(MARK) + F.col("_high").bitwiseAND(MARK) != MARK
    since = F.unix_millis(F.col("window.start"))
    moment = lambda place: since + F.get("_ticks", F.lit(place))
    return (
        minutes.withColumn("_steps", _steps(F.transform("_ticks", lambda t: F.struct(t.cast("bigint").alias("at"))), "at", "at"))
        # events beyond the first of a millisecond follow at a gap of zero
        .withColumn("_repeats", F.col("events") - F.size("_ticks"))
        .select(
            F.window_time("window").alias(PANE_TIME),
            "ip_address",
            moment(0).alias("start"),
            (since + F.element_at("_ticks", -1)).alias("end"),
            F.when(tied, moment(0)).otherwise(moment(1)).alias("second"),
            "events",
            F.when(F.col("_repeats") > 0, F.lit(0).cast("bigint")).otherwise(F.array_min("_steps")).alias("fastest"),
            (F.col("_repeats") + _below(F.col("_steps"), rules.ultra_fast_gap_ms)).alias("ultra"),
            (F.col("_repeats") + _below(F.col("_steps"), rules.very_fast_gap_ms)).alias("very"),
            *_SEEN,
        )
    )


def velocity_metrics(
    timed: DataFrame, rules: DetectionRules = DETECTION, slide: str = "1 hour"
) -> DataFrame:
    """Gap statistics per sliding window and address, exact.

    Milliseconds within a minute, then minutes within the sliding window (at
    most 1,440 for a day). As in batch, the first event of a window has no gap
    and ``first_seen`` is the second one, here to the millisecond.
    """
    return over_panes(velocity_panes(timed, rules), rules, slide)


def _least_gap(rows: Column, between: Column) -> Column:
    # a pane of one event has no gap; the columns that come through Python have no nulls
    return F.least(F.array_min(F.transform(rows, lambda p: F.when(p["events"] > 1, p["fastest"]))), F.array_min(between))


def _velocity_of(rows: Column, rules: DetectionRules) -> dict[str, Column]:
    """Velocity metrics of a window from its panes in the order of time; ``total_clicks`` may be zero."""
    between = _steps(rows, "start", "end")
    clicks = _total(_each(rows, "events")) - 1
    first, last = F.get(rows, F.lit(0)), F.element_at(rows, -1)
    return {
        "total_clicks": clicks,
        "fastest_click_ms": _least_gap(rows, between),
        "avg_click_interval_ms": (last["end"] - first["start"]).cast("double") / clicks.cast("double"),
        "ultra_fast_clicks": _total(_each(rows, "ultra")) + _below(between, rules.ultra_fast_gap_ms),
        "very_fast_clicks": _total(_each(rows, "very")) + _below(between, rules.very_fast_gap_ms),
        "country_code": F.array_min(_each(rows, "country_code")),
        "device_type": F.array_min(_each(rows, "device_type")),
        "first_seen": F.timestamp_millis(
            F.when(first["events"] > 1, first["second"]).otherwise(F.get(rows, F.lit(1))["start"])
        ).cast("timestamp_ntz"),
        "last_seen": _moment(F.array_max(_each(rows, "last_us"))),
    }


def _without_nulls(velocity: DataFrame) -> DataFrame:
    return velocity.fillna(0, ["second", "fastest"])


def _has_gap(rows: Column) -> Column:
    return _total(_each(rows, "events")) > 1


def _has_gap_in(panes: pa.Table, of: np.ndarray, lists: int) -> np.ndarray:
    return np.bincount(of, panes.column("events").to_numpy(), lists) > 1


def _fast_in(panes: pa.Table, of: np.ndarray, lists: int, rules: DetectionRules) -> np.ndarray:
    """Lists of panes of which any window may be over an entry cut-off: its gaps are among those of the list, their mean is no less than the least."""
    start, end, events, fastest, ultra = (panes.column(c).to_numpy() for c in ("start", "end", "events", "fastest", "ultra"))
    least = np.full(lists, np.iinfo(np.int64).max)
    np.minimum.at(least, of[events > 1], fastest[events > 1])
    after = np.flatnonzero(of[1:] == of[:-1]) + 1  # panes that follow another of their list
    between = start[after] - end[after - 1]
    np.minimum.at(least, of[after], between)
    repeated = np.bincount(of, ultra, lists) + np.bincount(of[after], between < rules.ultra_fast_gap_ms, lists)
    fast = (least < max(rules.very_fast_gap_ms, rules.sustained_avg_gap_ms)) | (repeated > rules.repeated_ultra_fast)
    return fast & _has_gap_in(panes, of, lists)


def _many_in(panes: pa.Table, of: np.ndarray, lists: int, rules: DetectionRules) -> np.ndarray:
    return np.bincount(of, panes.column("events").to_numpy(), lists) > _least_events(rules)


def _suspect_in(panes: pa.Table, of: np.ndarray, lists: int, rules: DetectionRules) -> np.ndarray:
    by_volume = panes.column("of_volume").to_numpy() == 1
    sides = ((_many_in, by_volume), (_fast_in, ~by_volume))
    many, fast = (told(panes.filter(pa.array(side)), of[side], lists, rules) for told, side in sides)
    return many | fast


def over_panes(
    velocity: DataFrame, rules: DetectionRules = DETECTION, slide: str = "1 hour", keyed: bool = False, suspects: bool = False
) -> DataFrame:
    """Sliding windows over rows with the fields ``VELOCITY_PANE``, at most one per address and stretch of time.

    With ``suspects``, those of an address and day of windows that has no suspect among them are left out.
    """
    told = partial(_fast_in, rules=rules) if suspects else _has_gap_in
    windows = panes.sliding(_without_nulls(velocity), PANE_TIME, VELOCITY_PANE, "start", rules.window_hours, slide, keyed, told=told)
    return windows.where(_has_gap(F.col("panes"))).select(
        *WINDOW_KEYS, *_named(_velocity_of(F.col("panes"), rules))
    )


def high_volume_suspects(timed: DataFrame, rules: DetectionRules = DETECTION, slide: str = "1 hour") -> DataFrame:
    told = partial(_many_in, rules=rules)
    windows = panes.sliding(volume_panes(timed, slide), PANE_TIME, VOLUME_PANE, "first_us", rules.window_hours, slide, told=told)
    many = windows.where(_enough(F.col("panes"), rules)).select(*WINDOW_KEYS, *_named(_volume_of(F.col("panes"))))
    return flag_high_volume(many, rules)


def _enough(rows: Column, rules: DetectionRules) -> Column:
    """Whether a window has the events that any entry cut-off asks for; there are no more different values than events."""
    return _total(_each(rows, "events")) > _least_events(rules)


def _least_events(rules: DetectionRules) -> int:
    return min(rules.high_volume_events, rules.rotating_uas, rules.many_campaigns)


def high_velocity_suspects(timed: DataFrame, rules: DetectionRules = DETECTION, slide: str = "1 hour") -> DataFrame:
    return flag_high_velocity(over_panes(velocity_panes(timed, rules), rules, slide, suspects=True), rules)


def suspect_ips(timed: DataFrame, rules: DetectionRules = DETECTION, slide: str = "1 hour") -> DataFrame:
    """Both detectors merged per window and address, stamped with the window end.

    The panes of both are kept together, so a window is one row and merging is column expressions.
    """
    by_volume, by_velocity = volume_panes(timed, slide), _without_nulls(velocity_panes(timed, rules))
    pane = {"of_volume": "long", **VOLUME_PANE, **VELOCITY_PANE}

    def laid_out(rows: DataFrame, of_volume: int, own: dict[str, str]) -> DataFrame:
        # numbers have no nulls on their way through Python
        other = {"long": F.lit(0).cast("long"), "binary": F.lit(None).cast("binary")}
        fields = [(F.col(n) if n in own else other[t]).alias(n) for n, t in pane.items() if n != "of_volume"]
        return rows.select(PANE_TIME, "ip_address", F.lit(of_volume).cast("long").alias("of_volume"), *fields)

    both = laid_out(by_volume, 1, VOLUME_PANE).unionByName(laid_out(by_velocity, 0, VELOCITY_PANE))
    windows = panes.sliding(both, PANE_TIME, pane, "start", rules.window_hours, slide, told=partial(_suspect_in, rules=rules))
    of = lambda kind: F.filter(F.col("panes"), lambda p: p["of_volume"] == kind)
    sides = windows.select(*WINDOW_KEYS, of(1).alias("_by_volume"), of(0).alias("_by_velocity"))
    volume = F.when(_enough(F.col("_by_volume"), rules), F.struct(*_named(_volume_of(F.col("_by_volume")))))
    velocity = F.when(_has_gap(F.col("_by_velocity")), F.struct(*_named(_velocity_of(F.col("_by_velocity"), rules))))
    metrics = sides.select(*WINDOW_KEYS, volume.alias("volume"), velocity.alias("velocity"))
    found = metrics.select(*WINDOW_KEYS, *_named(detector_rows(rules))).where("volume IS NOT NULL OR velocity IS NOT NULL")
    merged = found.select(*WINDOW_KEYS, *_named(merged_row(F.col("volume"), F.col("velocity"))))
    return finish_suspects(merged, F.col("window.end"), rules)
