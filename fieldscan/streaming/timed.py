"""Streams walked in order of event time, with deadlines: rows may come late and in any order, and silence itself gives rows.

Rows wait in the state of their key until the watermark has passed them, for a later batch can no longer hold an earlier one;
then a walk takes them in order of (t, seq). A walk may name a deadline, and is called at it when no row came up to then: an
event-time timer wakes the key, so a key without rows is woken by the progress of the others. What waits is what `lateness` of
the stream holds. Results equal those of the batch forms in operators, wherever the stream was cut into batches.

Streams have ts TIMESTAMP beside t (its seconds); ts carries the watermark. State lives in RocksDB, which timers need.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import fold

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Walk:
    """A walk over a key's rows in order. init() makes its state; step(state, row) gives the next state and rows of results;
    due(state) is the time of its deadline, if any; overdue(state, t) is called at it. Rows at the deadline come before it."""

    init: Callable[[], Any]
    step: Callable[[Any, dict], tuple[Any, list[dict]]]
    due: Callable[[Any], float | None] = lambda state: None
    overdue: Callable[[Any, float], tuple[Any, list[dict]]] = lambda state, t: (state, [])


def one_each(init: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict]]) -> Walk:
    """The walk of a fold that gives one result for each row."""

    def each(state, row):
        state, result = step(state, row)
        return state, [result]

    return Walk(init, each)


def millis(t: float) -> int:
    return math.ceil(round(t * 1000, 6))


class InOrder(StatefulProcessor):
    """Keeps a key's rows until a timer says that the watermark is past them, and runs the walk over them and its deadlines."""

    def __init__(self, key: list[str], columns: list[str], made: list[str], walk: Walk):
        self.key, self.columns, self.made, self.walk = key, columns, made, walk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "held binary")

    def close(self) -> None:
        pass

    def load(self) -> tuple[list[tuple], Any]:
        return pickle.loads(self.state.get()[0]) if self.state.exists() else ([], self.walk.init())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting, state = self.load()
        names = ["t", "seq", *self.columns]
        new = [tuple(v.item() if hasattr(v, "item") else v for v in values) for pdf in rows for values in zip(*[pdf[c] for c in names], strict=True)]
        for t in {millis(r[0]) for r in new}:
            self.handle.registerTimer(t)
        self.state.update((pickle.dumps((waiting + new, state)),))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()  # so the first timer of a batch does the work of the others
        waiting, state = self.load()
        ready = sorted((r for r in waiting if millis(r[0]) <= now), key=lambda r: r[:2])
        waiting = [r for r in waiting if millis(r[0]) > now]
        out, place = [], 0
        while True:
            due = self.walk.due(state)
            if due is not None and millis(due) <= now and (place == len(ready) or due < ready[place][0]):
                state, results = self.walk.overdue(state, due)
                out += [(*key, due, None, *[r[m] for m in self.made]) for r in results]
            elif place < len(ready):
                row = {c: None if v is None or v != v else v for c, v in zip(["t", "seq", *self.columns], ready[place], strict=True)}
                state, results = self.walk.step(state, row)
                out += [(*key, row["t"], row["seq"], *[r[m] for m in self.made]) for r in results]
                place += 1
            else:
                break
        if due is not None:
            self.handle.registerTimer(millis(due))
        self.state.update((pickle.dumps((waiting, state)),))
        if out:
            yield pd.DataFrame(out, columns=[*self.key, "t", "seq", *self.made], dtype=object)


def walk_in_order(stream: DataFrame, key: list[str], columns: list[str], out: str, walk: Walk, lateness: str) -> DataFrame:
    """(key, t, seq, and the columns of out) of a walk over each key's rows of a stream (key, ts, t, seq, columns); the seq of
    what a deadline gave is null. Rows that come later than `lateness` are dropped, as the watermark states."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*key, "t", "seq"]) + f", {out}"
    made = [x.split()[0] for x in out.split(",")]
    picked = stream.select(*key, "ts", "t", "seq", *columns).withWatermark("ts", lateness)
    return picked.groupBy(*key).transformWithStateInPandas(InOrder(key, columns, made, walk), schema, "append", "EventTime")


def hold_walk(hold_s: float) -> Walk:
    """Each value and until when it holds; a row of nulls when it ends without a newer one."""

    def step(until, row):
        if row["value"] is None:
            return until, []
        until = row["t"] + hold_s
        return until, [{"value": row["value"], "until": until}]

    return Walk(lambda: None, step, lambda until: until, lambda until, t: (None, [{"value": None, "until": None}]))


def health_walk(limits: dict[str, float]) -> Walk:
    """Changes of the first unhealthy reason in the order of limits: a topic is stale `limits` seconds after its last message,
    or if it never came; a limit of 0 never ends. The state has the last message of each topic that is not stale."""
    watched = {topic: limit for topic, limit in limits.items() if limit > 0}

    def judged(seen: dict, reason: str | None):
        new = next((f"{topic}_timeout" for topic in watched if topic not in seen), "healthy")
        return (seen, new), [] if new == reason else [{"health": new}]

    def step(state, row):
        seen, reason = state
        return judged({**seen, row["topic"]: row["t"]} if row["topic"] in watched else seen, reason)

    def due(state):
        return min((t + watched[topic] for topic, t in state[0].items()), default=None)

    def overdue(state, now):
        return judged({topic: t for topic, t in state[0].items() if t + watched[topic] > now}, state[1])

    return Walk(lambda: ({}, None), step, due, overdue)


def sync_walk(slop: float) -> Walk:
    """Pairs of messages of two sides that are each other's nearest within slop, ties to the smaller seq. A pair is known when
    twice slop has passed: no later message is nearer to either. The state has the messages of both sides, and those of the
    first that are not decided."""

    def nearest(t, others):
        return min(((abs(o[0] - t), o[1]) for o in others if abs(o[0] - t) <= slop), default=None)

    def trimmed(sides, open_, now):
        past = min(now, open_[0][0] if open_ else now) - 2 * slop
        return tuple([m for m in side if m[0] >= past] if side and side[0][0] < past else side for side in sides)

    def step(state, row):
        sides, open_ = state
        message = (row["t"], row["seq"])
        sides = tuple([*side, message] if k == row["side"] else side for k, side in enumerate(sides))
        open_ = open_ if row["side"] else [*open_, message]
        return (trimmed(sides, open_, row["t"]), open_), []

    def due(state):
        return state[1][0][0] + 2 * slop if state[1] else None

    def overdue(state, now):
        (left, right), (own, *open_) = state
        found, out = nearest(own[0], right), []
        if found is not None:
            other = next(o for o in right if (abs(o[0] - own[0]), o[1]) == found)
            if nearest(other[0], left) == (found[0], own[1]):
                out = [{"a_seq": own[1], "b_seq": other[1], "dt": found[0]}]
        return (trimmed((left, right), open_, now), open_), out

    return Walk(lambda: (([], []), []), step, due, overdue)


def stream_hold(frames: DataFrame, hold_s: float, lateness: str) -> DataFrame:
    """(device_id, channel, t, seq, value, until) of live frames (device_id, channel, ts, t, seq, value): each value, and a null
    one when its time is up without a newer. operators.health.hold_events gives the same of a table."""
    return walk_in_order(frames, ["device_id", "channel"], ["value"], "value double, until double", hold_walk(hold_s), lateness)


def stream_health(messages: DataFrame, limits: dict[str, float], lateness: str) -> DataFrame:
    """(device_id, t, seq, health) of live messages (device_id, topic, ts, t, seq): a row whenever the first unhealthy reason
    changes, also while nothing comes. operators.health.health_changes gives the same of a table."""
    return walk_in_order(messages, ["device_id"], ["topic"], "health string", health_walk(limits), lateness)


def stream_stale(received: DataFrame, timeout: float, lateness: str) -> DataFrame:
    """(device_id, t, seq, current) of live receptions (device_id, ts, t, seq): a row whenever a source becomes current or stale."""
    live = stream_health(received.withColumn("topic", F.lit("source")), {"source": timeout}, lateness)
    return live.select("device_id", "t", "seq", (F.col("health") == "healthy").alias("current"))


def stream_sync(a: DataFrame, b: DataFrame, slop: float, lateness: str) -> DataFrame:
    """(device_id, a_seq, b_seq, dt) of two live topics (device_id, ts, t, seq): pairs within slop seconds, each message used once,
    as operators.timejoin.nearest_time_join pairs tables. State holds four times slop and lateness of a device."""
    both = a.select("device_id", "ts", "t", "seq", F.lit(0).alias("side")).unionByName(b.select("device_id", "ts", "t", "seq", F.lit(1).alias("side")))
    out = walk_in_order(both, ["device_id"], ["side"], "a_seq long, b_seq long, dt double", sync_walk(slop), lateness)
    return out.select("device_id", "a_seq", "b_seq", "dt")


def stream_filter(ranges: DataFrame, n: int, max_jump: float, danger: float, warn: float, trigger: int, clear: int, lateness: str) -> DataFrame:
    """Median filter and debounced latches on live ranges (device_id, channel, ts, t, seq, value): the batch steps, one after the
    other in one state."""
    (start_m, median), (start_d, latch) = fold.median_step(n, max_jump), fold.debounce_step(danger, warn, trigger, clear)

    def step(state, row):
        m, filtered = median(state[0], row)
        d, flags = latch(state[1], {**row, "value": filtered["filtered"]})
        return (m, d), {**filtered, **flags}

    walk = one_each(lambda: (start_m(), start_d()), step)
    return walk_in_order(ranges, ["device_id", "channel"], ["value"], "filtered double, danger boolean, warn boolean", walk, lateness)


def stream_tracks(clusters: DataFrame, reach: float, ttl: float, lateness: str) -> DataFrame:
    """Obstacle tracks of live clusters (device_id, ts, t, seq, x, y), as fold.track_clusters gives them of a table; the clusters
    of a moment may come in several batches."""
    return walk_in_order(clusters, ["device_id"], ["x", "y"], "track long", one_each(*fold.track_step(reach, ttl)), lateness)
