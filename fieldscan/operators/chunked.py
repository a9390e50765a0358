"""Filters with feedback on long keys: the same results as a walk, in many tasks for one key.

A key is cut into chunks of time. What a chunk does to the state it is entered with is a small function, and functions of
chunks can be composed: first each chunk makes its function, then the states at the chunks' starts are walked, one step for each
chunk, and then each chunk is walked from its own start. The function is

- for the debounced latches a table: counts beyond their limits act alike, so there are finitely many states;
- for the low pass y -> a y + b within the first stretch without a reset, or a constant after one;
- for sampling the last kept time for each row that may be the first kept one: those within 1/hz of the chunk's first row, and the
  next.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import debounce_step, low_pass_step, sample_step


class Latches:
    """Debounced latches as a table of states."""

    out = "danger boolean, warn boolean"
    columns = ("value",)

    def __init__(self, danger: float, warn: float, trigger: int, clear: int):
        self.danger, self.warn, self.trigger, self.clear = danger, warn, trigger, clear
        self.init, step = debounce_step(danger, warn, trigger, clear)
        self.step = lambda state, row: (lambda s, r: (self.capped(s), r))(*step(state, row))
        self.states = list(product(range(trigger + 1), range(trigger + 1), range(clear + 1), (False, True), (False, True)))
        self.number = {s: k for k, s in enumerate(self.states)}
        self.moves = [np.array([self.number[self.step(s, {"value": v})[0]] for s in self.states], dtype=np.uint8 if len(self.states) < 256 else np.int32) for v in (danger - 1, (danger + warn) / 2, None)]

    def capped(self, s: tuple) -> tuple:
        return (min(s[0], self.trigger), min(s[1], self.trigger), min(s[2], self.clear), s[3], s[4])

    def begin(self) -> np.ndarray:
        return np.arange(len(self.states), dtype=self.moves[0].dtype)

    def absorb(self, table: np.ndarray, row: dict) -> np.ndarray:
        v = row["value"]
        return self.moves[2 if v is None or v >= self.warn else 0 if v < self.danger else 1][table]

    def carry(self, table: np.ndarray, state: tuple) -> tuple:
        return self.states[table[self.number[self.capped(state)]]]


class LowPass:
    """y += dt / (tau + dt) (x - y) as an affine function of the y it is entered with."""

    out = "filtered double"
    columns = ("value",)

    def __init__(self, tau: float, max_dt: float):
        self.tau, self.max_dt = tau, max_dt
        self.init, self.step = low_pass_step(tau, max_dt)

    def begin(self) -> tuple:
        return (None, None, None, None, None)  # first reading and its time, then a, b of what follows it, and the last time

    def absorb(self, f: tuple, row: dict) -> tuple:
        x, t = row["value"], row["t"]
        if x is None:
            return f
        first, first_t, a, b, last = f
        if first is None:
            return (x, t, 1.0, 0.0, t)
        dt = t - last
        if dt <= 0 or dt > self.max_dt or self.tau <= 1e-6:
            return (first, first_t, 0.0, x, t)
        share = dt / (self.tau + dt)
        return (first, first_t, a * (1 - share), b + share * (x - b), t)

    def carry(self, f: tuple, state: tuple) -> tuple:
        first, first_t, a, b, last = f
        if first is None:
            return state
        y = self.step(state, {"value": first, "t": first_t})[0][0]
        return (a * y + b, last)


class Sample:
    """Rows at least 1/hz after the last kept one, as the last kept time for each first one that can be."""

    out = "kept boolean"
    columns = ()

    def __init__(self, hz: float):
        self.gap = 1 / hz
        self.init, self.step = sample_step(hz)

    def begin(self) -> list:
        return []  # [first kept, last kept], by rising first

    def absorb(self, walks: list, row: dict) -> list:
        t = row["t"]
        for w in walks:
            if t - w[1] >= self.gap:
                w[1] = t
        if not walks or (walks[-1][0] - walks[0][0] < self.gap and walks[-1][0] != t):
            walks.append([t, t])
        return walks

    def carry(self, walks: list, last: float | None) -> float | None:
        for first, end in walks:
            if last is None or first - last >= self.gap:
                return end
        return last  # all rows are too early


def chunked_fold(df: DataFrame, key: list[str], chunk: float, rule: Any) -> DataFrame:
    """(key, t, seq, and the columns of rule.out) as ordered_fold of the rule's walk gives them, each key in chunks of `chunk`
    seconds. A task holds a row and a state; a key's states at chunk starts are walked in one task, a step for each chunk."""
    names = [*key, "_chunk"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(*key, "t", "seq", *rule.columns).withColumn("_chunk", F.floor(F.col("t") / chunk))
    dealt = rows.repartition(*names).sortWithinPartitions(*names, "t", "seq")
    typed = ", ".join(f"{k} {kinds[k]}" for k in key) + ", _chunk long"

    def row_of(values: dict) -> dict:
        return {c: None if v is None or v != v else v for c, v in values.items()}

    def rows_in(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[tuple, dict]]:
        for pdf in batches:
            for values in zip(*[pdf[c] for c in columns], strict=True):
                yield values[: len(names)], row_of(dict(zip(columns, values, strict=True)))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, f = None, None
        for pdf in batches:
            out = []  # chunks may be short, so those that end in a batch go together
            for own, row in rows_in([pdf], [*names, "t", "seq", *rule.columns]):
                if own != current:
                    if current is not None:
                        out.append((*current, pickle.dumps(f, -1)))
                    current, f = own, rule.begin()
                f = rule.absorb(f, row)
            yield pd.DataFrame(out, columns=[*names, "_f"])
        if current is not None:
            yield pd.DataFrame([(*current, pickle.dumps(f, -1))], columns=[*names, "_f"])

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for values in zip(*[pdf[c] for c in [*names, "_f"]], strict=True):
                if values[: len(key)] != current:
                    current, state = values[: len(key)], rule.init()
                out.append((*values[: len(names)], pickle.dumps(state, -1)))
                state = rule.carry(pickle.loads(values[-1]), state)
            yield pd.DataFrame(out, columns=[*names, "_start"])

    made = [x.split()[0] for x in rule.out.split(",")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for own, row in rows_in([pdf], [*names, "t", "seq", *rule.columns, "_start"]):
                if own != current:
                    current, state = own, pickle.loads(row["_start"])
                state, result = rule.step(state, row)
                out.append((*own[: len(key)], row["t"], row["seq"], *[result[m] for m in made]))
            yield pd.DataFrame(out, columns=[*key, "t", "seq", *made])

    functions = dealt.mapInPandas(summarise, typed + ", _f binary")
    starts = functions.repartition(*key).sortWithinPartitions(*names).mapInPandas(start, typed + ", _start binary")
    begun = rows.join(starts, names).repartition(*names).sortWithinPartitions(*names, "t", "seq")
    return begun.mapInPandas(walk, ", ".join(f"{c} {kinds[c]}" for c in [*key, "t", "seq"]) + f", {rule.out}")
