"""Filters with feedback: one keyed fold, the same step in batch and in a stream.

A fold walks a key's rows in order of (t, seq) with a small state. Keys run in parallel; each key is walked whole, in sorted
Arrow batches, and only the state stays in memory. Where a filter starts anew anyway (a segment, a day), a column that changes
there belongs into the key, so that a long record becomes many keys.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Step = Callable[[Any, dict], tuple[Any, dict]]


def ordered_fold(df: DataFrame, key: list[str], columns: list[str], out: str, init: Callable[[], Any], step: Step) -> DataFrame:
    """(key, t, seq, and the columns of out) of step(state, row) over each key's rows in order.

    Rows are dealt by key and sorted inside each partition; a task streams through them and keeps one state, so no key has
    to fit into memory. Missing numbers reach the step as None.
    """
    names = [*key, "t", "seq"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + f", {out}"
    made = [x.split()[0] for x in out.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            rows = []
            for values in zip(*[pdf[c] for c in names], *[pdf[c] for c in columns], strict=True):
                own = values[: len(key)]
                if own != current:
                    current, state = own, init()
                row = {c: None if v is None or v != v else v for c, v in zip([*names, *columns], values, strict=True)}
                state, result = step(state, row)
                rows.append((*values[: len(names)], *[result[m] for m in made]))
            yield pd.DataFrame(rows, columns=[*names, *made])

    return df.select(*names, *[c for c in columns if c not in names]).repartition(*key).sortWithinPartitions(*names).mapInPandas(run, schema)


def delayed_fold(df: DataFrame, key: list[str], columns: list[str], out: str, walk: Callable[[], Any]) -> DataFrame:
    """(key, t, seq, columns, and those of out) of a walk over each key's rows in order that decides on rows later.

    walk() makes an object for a key: push(row) returns results for rows that wait, oldest first, as soon as they are decided,
    finish() those of all that still wait. A task holds the rows that wait, as many as the walk needs, and never a whole key.
    """
    names = list(dict.fromkeys([*key, "t", "seq", *columns]))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + f", {out}"
    made = [x.split()[0] for x in out.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        waiting: deque[tuple] = deque()
        rows: list[tuple] = []

        def take(results: list[dict]) -> None:
            rows.extend((*waiting.popleft(), *[r[m] for m in made]) for r in results)

        for pdf in batches:
            for values in zip(*[pdf[c] for c in names], strict=True):
                own = values[: len(key)]
                if own != current:
                    if state is not None:
                        take(state.finish())
                    current, state = own, walk()
                waiting.append(values)
                take(state.push({c: None if v is None or v != v else v for c, v in zip(names, values, strict=True)}))
            yield pd.DataFrame(rows, columns=[*names, *made])
            rows.clear()
        if state is not None:
            take(state.finish())
            yield pd.DataFrame(rows, columns=[*names, *made])

    return df.select(*names).repartition(*key).sortWithinPartitions(*key, "t", "seq").mapInPandas(run, schema)


def median_step(n: int, max_jump: float) -> tuple[Callable[[], Any], Step]:
    """Median of the last n accepted values; a jump from the last output repeats that output instead; a missing value
    repeats it without entering."""

    def step(state, row):
        values, last = state
        x = row["value"]
        if x is not None:
            values = [*values, x if last is None or abs(x - last) <= max_jump else last][-n:]
            s = sorted(values)
            last = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        return (values, last), {"filtered": last}

    return lambda: ([], None), step


def debounce_step(danger: float, warn: float, trigger: int, clear: int) -> tuple[Callable[[], Any], Step]:
    """Latches: danger after `trigger` danger rows in a row, which sets warn too; warn after `trigger` warn rows; both clear
    after `clear` safe rows. A danger row leaves the warn count, a warn row resets the other two. A missing reading is neither
    danger nor warn and counts as safe."""

    def step(state, row):
        nd, nw, nc, is_danger, is_warn = state
        x = math.inf if row["value"] is None else row["value"]
        if x < danger:
            nd, nc = nd + 1, 0
            if nd >= trigger:
                is_danger = is_warn = True
        elif x < warn:
            nw, nd, nc = nw + 1, 0, 0
            if nw >= trigger:
                is_warn = True
        else:
            nd, nw, nc = 0, 0, nc + 1
            if nc >= clear:
                is_danger = is_warn = False
        return (nd, nw, nc, is_danger, is_warn), {"danger": is_danger, "warn": is_warn}

    return lambda: (0, 0, 0, False, False), step


def low_pass_step(tau: float, max_dt: float) -> tuple[Callable[[], Any], Step]:
    """y += dt / (tau + dt) * (x - y); the first row, and one after no or too much time, starts anew. Missing rows repeat y."""

    def step(state, row):
        y, t = state
        x = row["value"]
        if x is not None:
            dt = None if t is None else row["t"] - t
            y, t = (x if dt is None or dt <= 0 or dt > max_dt or tau <= 1e-6 else y + dt / (tau + dt) * (x - y)), row["t"]
        return (y, t), {"filtered": y}

    return lambda: (None, None), step


def sample_step(hz: float) -> tuple[Callable[[], Any], Step]:
    """Keeps a row when 1/hz seconds have passed since the last kept one."""

    def step(last, row):
        keep = last is None or row["t"] - last >= 1 / hz
        return (row["t"] if keep else last), {"kept": keep}

    return lambda: None, step


def stuck_step(distance: float, timeout: float) -> tuple[Callable[[], Any], Step]:
    """Seconds since the robot was last `distance` from its anchor pose; stuck beyond timeout (0 turns it off)."""

    def step(state, row):
        if state is None or ((row["x"] - state[0]) ** 2 + (row["y"] - state[1]) ** 2) ** 0.5 >= distance:
            state = (row["x"], row["y"], row["t"])
        idle = row["t"] - state[2]
        return state, {"idle": idle, "stuck": timeout > 0 and idle > timeout}

    return lambda: None, step


def mean_time_step(scale: float) -> tuple[Callable[[], Any], Step]:
    """Running mean of accepted durations; a duration under `scale` of the mean is not counted."""

    def step(state, row):
        n, mean = state
        x = row["value"]
        if x is not None and x >= scale * mean:
            n, mean = n + 1, mean + (x - mean) / (n + 1)
        return (n, mean), {"mean": mean if n else None, "counted": n}

    return lambda: (0, 0.0), step


def track_step(reach: float, ttl: float) -> tuple[Callable[[], Any], Step]:
    """Each cluster takes the nearest live track within reach that no cluster of the same t has taken, or starts one. A track
    lives ttl seconds after its last cluster."""

    def step(state, row):
        tracks, serial, now, used = state
        if row["t"] != now:
            now, used = row["t"], frozenset()
            tracks = {i: p for i, p in tracks.items() if p[2] > now}
        near = sorted((((p[0] - row["x"]) ** 2 + (p[1] - row["y"]) ** 2) ** 0.5, i) for i, p in tracks.items() if i not in used)
        if near and near[0][0] <= reach:
            chosen = near[0][1]
        else:
            chosen, serial = serial, serial + 1
        tracks = {**tracks, chosen: (row["x"], row["y"], now + ttl)}
        return (tracks, serial, now, used | {chosen}), {"track": chosen}

    return lambda: ({}, 0, None, frozenset()), step


def track_clusters(clusters: DataFrame, key: list[str], reach: float, ttl: float) -> DataFrame:
    """(key, t, seq, track) of clusters (t, size, x, y): those of one time by falling size, then x and y; seq is that order."""
    place = F.row_number().over(W.partitionBy(*key, "t").orderBy(F.desc("size"), "x", "y")).cast("long")
    return ordered_fold(clusters.withColumn("seq", place), key, ["x", "y"], "track long", *track_step(reach, ttl))


def arrival_step(waypoints: list[tuple[float, float]], within: float) -> tuple[Callable[[], Any], Step]:
    """The waypoint reached by a row, if any: the next one in order, when the row is nearer than `within` in x and in y. A row
    reaches one waypoint at most."""

    def step(done, row):
        if done < len(waypoints) and all(abs(row[c] - v) < within for c, v in zip("xy", waypoints[done], strict=True)):
            return done + 1, {"waypoint": done}
        return done, {"waypoint": None}

    return lambda: 0, step


def alignment_step(enter: float, leave: float, hold: float, nearest: float, moved: float = 0.05) -> tuple[Callable[[], Any], Step]:
    """Whether a robot turns towards its goal before it drives. Rows are goals (gx, gy) or poses (x, y, yaw), in order; a goal is
    new when its time or, by more than `moved`, its place changes. From a heading error of `enter` degrees on, once a goal,
    until the error stayed within `leave` degrees for `hold` seconds. A goal nearer than `nearest` needs no turn."""

    def step(state, row):
        goal, active, done, since = state
        if row["gx"] is not None:
            new = goal is None or row["t"] != goal[2] or math.hypot(row["gx"] - goal[0], row["gy"] - goal[1]) > moved
            goal = (row["gx"], row["gy"], row["t"])
            if new:
                active, done, since = False, False, None
        elif goal is not None:
            dx, dy = goal[0] - row["x"], goal[1] - row["y"]
            if math.hypot(dx, dy) < nearest:
                active, done, since = False, True, None
            else:
                error = math.degrees(abs((math.atan2(dy, dx) - row["yaw"] + math.pi) % (2 * math.pi) - math.pi))
                if not done and not active and error >= enter:
                    active, since = True, None
                if active and error <= leave:
                    since = row["t"] if since is None else since
                    if row["t"] - since >= hold:
                        active, done, since = False, True, None
                elif active:
                    since = None
        return (goal, active, done, since), {"aligning": active}

    return lambda: (None, False, False, None), step


def stream_fold(stream: DataFrame, key: list[str], columns: list[str], out: str, init: Callable[[], Any], step: Step) -> DataFrame:
    """ordered_fold over a stream: state lives in the state store between batches; the rows of a batch are walked in order."""
    import pickle

    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [*key, "t", "seq"]
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + f", {out}"
    made = [x.split()[0] for x in out.split(",")]

    def run(_key, batches, state):
        held = pickle.loads(state.get[0]) if state.exists else init()
        pdf = pd.concat(list(batches)).sort_values(["t", "seq"])
        rows = []
        for values in zip(*[pdf[c] for c in names], *[pdf[c] for c in columns], strict=True):
            row = {c: None if v is None or v != v else v for c, v in zip([*names, *columns], values, strict=True)}
            held, result = step(held, row)
            rows.append((*values[: len(names)], *[result[m] for m in made]))
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(rows, columns=[*names, *made])

    picked = stream.select(*names, *[c for c in columns if c not in names])
    return picked.groupBy(*key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)
