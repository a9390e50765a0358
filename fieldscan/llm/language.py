"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Words are lower-cased runs of letters, padded on both sides; a model gives the probability of each character after up to
three before it, inside the padded word. The counts of all 4-character runs per language come from every learning row:
each task counts its distinct words once and sums partial counts before the shuffle. Lower orders are continuation
counts of the order above, and back-off weights what discounts leave; all are Spark aggregations over all runs. Runs
with less than LEAST of an order's count in their language are left to the order below, so a model has at most 1 / LEAST
runs of an order whatever the table's size, and still sums to one. For each order the models of all languages share one
array of sorted 64-bit hashes, with the (language, probability) entries of each hash in a row, which a binary search reads.

A text goes to the language with the lowest cross-entropy per character. The score is a posterior; its temperature, and
the cross-entropy above which a text is marked as rejected, are fitted on a tenth of the learning rows by a model of the
other nine tenths.

Null texts and texts without a letter are `und` with score 0, and rejected. Ties go to the language that sorts first.
Without a learning row every text is `und`. Repeated rows count as often as they occur. identify keeps other columns and
replaces lang_pred, score and rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, saved, table

ORDER = 4
LETTERS = regex.compile(r"\p{L}+")
PAD_LEFT, PAD_RIGHT = "\x02" * (ORDER - 1), "\x03"
#: Share of an order's count in a language below which a run is left to lower orders.
LEAST = 2.0**-20
DISCOUNT = 0.75
#: Characters beyond which a text is no surer.
LENGTH = 200
#: Characters over which the lowest order's back-off is spread evenly.
CHARACTERS = 1_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Temperature and limits are fitted on one in FOLDS of the distinct learning texts, each time on GRID temperatures at once.
FOLDS, GRID = 10, 33


def letter_words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def hash_runs(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points."""
    out = np.full(len(codes), 14695981039346656037, dtype=np.uint64)
    for k in range(codes.shape[1]):
        out = (out ^ codes[:, k].astype(np.uint64)) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def many_runs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all words, one below the other, and the place where each word's runs begin. Words are joined once: the
    runs that cross a border are left out."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    joined = "".join([PAD_LEFT + w + PAD_RIGHT for w in words])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    views = np.lib.stride_tricks.sliding_window_view(points, ORDER)
    begins = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    within = np.arange(int((sizes + 1).sum())) - np.repeat(starts, sizes + 1)
    return views[np.repeat(begins, sizes + 1) + within], starts


def run_counts(docs: DataFrame) -> DataFrame:
    """(fold, lang, run, n) over all rows of docs (fold, lang, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[bool, str], dict[str, int]] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for (fold, lang), seen in held.items():
                words = list(seen)
                if not words:
                    continue
                runs, _ = many_runs(words)
                weights = np.repeat(np.fromiter(seen.values(), dtype=np.int64), [len(w) + 1 for w in words])
                text = np.ascontiguousarray(runs).view(f"<U{ORDER}").ravel()
                which, total = np.unique(text, return_inverse=True)
                yield pd.DataFrame({"fold": fold, "lang": lang, "run": which, "n": np.bincount(total, weights=weights).astype(np.int64)})
            held.clear()

        for pdf in batches:
            for fold, lang, text in zip(pdf["fold"], pdf["lang"], pdf["text"], strict=True):
                seen = held.setdefault((fold, lang), {})
                for w in letter_words(text):
                    seen[w] = seen.get(w, 0) + 1
            if sum(map(len, held.values())) > 200_000:
                yield from flush()
        yield from flush()

    partial = docs.select("fold", "lang", "text").mapInPandas(count, "fold boolean, lang string, run string, n long")
    return partial.groupBy("fold", "lang", "run").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Sorted hashes; entries starts[k] to starts[k + 1] of `lang` and `value` belong to hash k. `fill` stands for any other."""

    keys: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    value: np.ndarray
    fill: float
    #: One row of all languages for each hash, made in a worker where it takes at most four times the room of the entries.
    matrix: np.ndarray | None = None

    @classmethod
    def of(cls, hashes: np.ndarray, lang: np.ndarray, value: np.ndarray, fill: float) -> Table:
        order = np.lexsort((lang, hashes))
        keys, starts = np.unique(hashes[order], return_index=True)
        return cls(keys, np.append(starts, len(hashes)), lang[order].astype(np.int32), value[order].astype(np.float32), fill)

    def part(self, wanted: list[int]) -> Table:
        """The entries of those languages, numbered anew."""
        at = np.searchsorted(wanted, self.lang)
        mine = np.isin(self.lang, wanted)
        return Table.of(np.repeat(self.keys, np.diff(self.starts))[mine], at[mine], self.value[mine], self.fill)

    def look_up(self, wanted: np.ndarray, languages: int) -> np.ndarray:
        """(n, languages) values of the wanted hashes."""
        if not len(self.keys):
            return np.full((len(wanted), languages), self.fill)
        if self.matrix is None and len(self.keys) * languages <= 4 * len(self.value):
            self.matrix = np.full((len(self.keys) + 1, languages), self.fill)
            self.matrix[np.repeat(np.arange(len(self.keys)), np.diff(self.starts)), self.lang] = self.value
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[at] == wanted
        if self.matrix is not None:
            return self.matrix[np.where(found, at, len(self.keys))]
        out = np.full((len(wanted), languages), self.fill)
        rows = np.flatnonzero(found)
        first, last = self.starts[at[rows]], self.starts[at[rows] + 1]
        n = last - first
        entry = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        out[np.repeat(rows, n), self.lang[entry]] = self.value[entry]
        return out


@dataclass
class Model:
    languages: list[str]
    #: For each order 1..ORDER: discounted probabilities of the runs.
    grams: list[Table]
    #: For each order 2..ORDER: back-off weights of the contexts, 1 for any other.
    contexts: list[Table]
    #: Back-off weight of each language's order 1, spread evenly over CHARACTERS.
    floor: np.ndarray
    temperature: float = 1.0
    limits: np.ndarray | None = None
    #: Places and sums of the words that a worker has met, kept from task to task.
    met: dict[str, int] = field(default_factory=dict)
    sums: np.ndarray | None = None

    def probability(self, runs: np.ndarray) -> np.ndarray:
        """(n, languages) probability of the last character of each run after the others."""
        n = len(self.languages)
        p = np.full((len(runs), n), 1.0 / CHARACTERS)
        for order in range(1, ORDER + 1):
            tail = runs[:, ORDER - order :]
            p *= self.contexts[order - 2].look_up(hash_runs(tail[:, :-1]), n) if order > 1 else self.floor
            p += self.grams[order - 1].look_up(hash_runs(tail), n)
        return p

    def part(self, prefix: str) -> Model:
        """The models of the languages whose names begin so, without the beginning."""
        wanted = [k for k, name in enumerate(self.languages) if name.startswith(prefix)]
        pick = lambda tables: [t.part(wanted) for t in tables]
        return Model([self.languages[k].removeprefix(prefix) for k in wanted], pick(self.grams), pick(self.contexts), self.floor[wanted])

    def entropy(self, words: list[str]) -> np.ndarray:
        """(words, languages) sum of -log2 p over each word's characters and end."""
        if not words:
            return np.zeros((0, len(self.languages)))
        runs, starts = many_runs(words)
        return np.add.reduceat(-np.log2(self.probability(runs)), starts, axis=0)


def hash_of(runs: str) -> Column:
    """hash_runs of strings of one length."""

    @F.pandas_udf("long")
    def of(runs: pd.Series) -> pd.Series:
        points = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return pd.Series(hash_runs(points.reshape(len(runs), -1)).view(np.int64) if len(runs) else np.zeros(0, dtype=np.int64))

    return of(runs)


def kneser_ney(counts: DataFrame, least: float = LEAST) -> Model:
    """The models from (lang, run, n), all computed over all runs; the driver gets hashes and numbers of the runs kept."""
    number = {name: k for k, name in enumerate(sorted(r["lang"] for r in counts.select("lang").distinct().collect()))}
    grams, contexts, floor = [], [], np.ones(len(number))
    level = counts
    for order in range(ORDER, 0, -1):
        whole = level.groupBy("lang").agg(F.sum("n").alias("whole"))  # one row for each language
        placed = level.join(F.broadcast(whole), "lang").withColumn("context", F.substring("run", 1, order - 1))
        p = placed.withColumn("p", (F.col("n") - DISCOUNT) / F.sum("n").over(W.partitionBy("lang", "context")))
        kept = saved(p.where(F.col("n") / F.col("whole") >= least).select("lang", "context", "p", hash_of("run").alias("h")))
        got = kept.select("lang", "h", "p").toPandas()
        grams.insert(0, Table.of(got["h"].to_numpy().view(np.uint64), got["lang"].map(number).to_numpy(dtype=np.int32), got["p"].to_numpy(), 0.0))
        left = kept.groupBy("lang", "context").agg((1 - F.sum("p")).alias("left"))
        if order > 1:
            got = left.select("lang", "left", hash_of("context").alias("h")).toPandas()
            contexts.insert(0, Table.of(got["h"].to_numpy().view(np.uint64), got["lang"].map(number).to_numpy(dtype=np.int32), got["left"].to_numpy(), 1.0))
            level = saved(level.groupBy("lang", F.substring("run", 2, order - 1).alias("run")).agg(F.count("*").alias("n")))
        else:
            for r in left.collect():
                floor[number[r["lang"]]] = r["left"]
    return Model(list(number), grams, contexts, floor)


def train(docs: DataFrame) -> Model:
    """Models of docs (lang, text) with non-null lang. Temperature and rejection limits are fitted on all distinct texts of one
    fold, by a model of the others; the driver gets sums and quantiles alone."""
    text_hash = F.xxhash64("text")
    fold = F.pmod(text_hash, F.lit(FOLDS)) == 0
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", fold.alias("fold"))
    counts = saved(run_counts(docs))
    if counts.isEmpty():
        return Model([], [], [], np.zeros(0))
    # both models in one pass, as if they were languages of their own
    name = lambda part: F.concat(F.lit(part), "lang").alias("lang")
    both = counts.groupBy("lang", "run").agg(F.sum("n").alias("n")).select(name("all "), "run", "n")
    both = kneser_ney(saved(both.unionByName(counts.where("NOT fold").select(name("not "), "run", "n"))))
    model, others = both.part("all "), both.part("not ")
    apart = docs.where("fold").select("lang", "text", text_hash.alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(others)

    @F.pandas_udf("array<double>")
    def entropies(texts: pd.Series) -> pd.Series:
        found = [text_entropy(shared.value, t) for t in texts]
        return pd.Series([[float(c), *(h / max(c, 1))] for h, c in found])

    if not others.languages:
        return model
    texts = apart.where(F.col("lang").isin(others.languages)).groupBy("lang", "h").agg(F.min("text").alias("text"))
    true = F.array_position(F.array(*[F.lit(name) for name in others.languages]), F.col("lang")).cast("int")
    measured = saved(texts.select("lang", true.alias("true"), entropies("text").alias("x"))).where(F.get("x", F.lit(0)) > 0)
    own = F.percentile_approx(F.get("x", F.col("true")), 0.999, 100_000)
    limit = {r["lang"]: r["own"] for r in measured.groupBy("lang").agg(own.alias("own")).collect()}  # one row for each language
    if limit:
        model.temperature = fit_temperature(measured)
        model.limits = np.array([limit.get(name, np.inf) for name in model.languages])
    return model


def fit_temperature(measured: DataFrame) -> float:
    """The factor of -bits under which a softmax makes the true columns likeliest, to a thousandth of its logarithm. Rows have `x`,
    characters and bits a character of each language, and `true`, the true one from 1. Of a grid the best place is looked at finer."""
    low, high = math.log(1e-4), math.log(2.0)
    while high - low > 1e-3:
        grid = np.linspace(low, high, GRID)

        def losses(batches: Iterator[pd.DataFrame], grid: np.ndarray = grid) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(grid))
            for pdf in batches:
                if len(pdf):
                    x, at = np.stack(pdf["x"].to_list()), pdf["true"].to_numpy() - 1
                    bits = x[:, 1:] * np.minimum(x[:, :1], LENGTH)
                    total += [-np.log(softmax(-bits * math.exp(t))[np.arange(len(at)), at] + 1e-9).sum() for t in grid]
            yield pd.DataFrame({"k": range(len(grid)), "loss": total})

        sums = measured.select("true", "x").mapInPandas(losses, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
        best = min(sums, key=lambda r: (r["loss"], r["k"]))["k"]
        low, high = grid[max(0, best - 1)], grid[min(GRID - 1, best + 1)]
    return math.exp((low + high) / 2)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def text_entropy(model: Model, text: str | None) -> tuple[np.ndarray, int]:
    """Sum of -log2 p per language, and the number of characters it was taken over."""
    seen: dict[str, int] = {}
    for w in letter_words(text):
        seen[w] = seen.get(w, 0) + 1
    if not seen:
        return np.zeros(len(model.languages)), 0
    times = np.fromiter(seen.values(), dtype=float)
    h = model.entropy(list(seen))
    return times @ h, int((times * [len(w) + 1 for w in seen]).sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "lang_pred string, score double, rejected boolean"

    @F.pandas_udf(schema)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        most = 1_200_000 // max(4, len(model.languages))
        if model.sums is None:
            model.sums = np.zeros((0, len(model.languages)))
        for texts in batches:
            split = [letter_words(t) if model.languages else [] for t in texts]
            if len(model.met) > most:
                model.met.clear()
                model.sums = model.sums[:0]
            new = list(set(filterfalse(model.met.__contains__, chain.from_iterable(split))))
            for at in range(0, len(new), most // 6):
                part = new[at : at + most // 6]
                model.met.update(zip(part, range(len(model.sums), len(model.sums) + len(part)), strict=True))
                model.sums = np.concatenate([model.sums, model.entropy(part)])
            out = []
            for ws in split:
                if not ws:
                    out.append(("und", 0.0, True))
                    continue
                n = sum(map(len, ws)) + len(ws)
                h = model.sums[np.fromiter(map(model.met.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0) / n
                k = int(np.argmin(h))
                p = softmax(-h * min(n, LENGTH) * model.temperature)
                out.append((model.languages[k], float(p[k]), bool(model.limits is not None and h[k] > model.limits[k])))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    both = docs.select(F.struct(*rest).alias("row"), predict("text").alias("found"))
    return both.select("row.*", "found.*")


def query(spark, sf_dir):
    """op7: predicted language of every document, learned from rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"), 5, 0)
    model = train(docs.where(~fold))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", fold.alias("held_out"), "lang_pred", "score", "rejected")
