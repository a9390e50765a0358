"""Toxicity: a learned lexicon, matched through Levenshtein automata, with windows that tell quotation from abuse.

Lexicon. From a bounded sample of labelled rows, Spark first leaves one row of each family of near copies (rows of a label
that share one of three least hashes of five-word shingles), so a copied document does not teach its every word. It then
counts, for each word and each beginning of a word, the toxic and other rows that hold it. Terms that a likelihood-ratio
test of fixed level finds to part the labels, with a far larger share among the toxic rows, are kept with the log ratio as
weight, whole words or stems, whichever parts the two kinds best.

Matching. The terms form a trie. Words run through the intersection of that trie with the Levenshtein automaton of each
term's error budget, made deterministic as states are met: whole words of 5 letters allow one error, of 9 two; stems of 6
letters one.

Context. Around each hit a window of words is read for quotation marks on both sides, words of report and words of
address. Quoted and reported hits count little, addressed ones more. A logistic model over a handful of sums, fitted on
the same sample, gives the score.

Null and empty texts have no hit and get the score of a text without one. Without labelled rows of both kinds every score
is 0. Repeated rows get equal scores; a repeated doc_id is learned from once for each label. Extra columns are kept by
score_toxicity.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, release, saved, table
from .simhash import shingle_hashes

WORD = re.compile(r"[^\W\d_]+")
STEM_SIZES = range(4, 9)
#: Labelled rows used at most, about.
SAMPLE = 4_000
#: Least likelihood ratio (chi-square with one degree: one in a million) and least ratio of shares of a term.
EVIDENCE, RATIO = 24.0, 6.0
WINDOW = 6
QUOTES = "\"'`«»‘’“”„"
#: Words of report and of address, in the languages of the tables.
REPORT = frozenset("said says say quote quoted quotes wrote writes reported according called sagte sagt schrieb zitat dit écrit cité dijo dice escribió cita".split())
ADDRESS = frozenset("you your yours du dein ihr euch tu toi vous votre usted tú ustedes".split())
FEATURES = 6


#: Odd multipliers that order a text's shingle hashes; the least under each names a family of near copies.
FAMILIES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Ends a term that is a stem.
STEM = "*"


def terms_of(text: str) -> list[str]:
    """The distinct words of a text, and the distinct beginnings of its words, marked with STEM."""
    words = {w for w in WORD.findall(text.lower()) if 3 <= len(w) <= 40}
    return [*words, *{w[:n] + STEM for w in words for n in STEM_SIZES if len(w) > n}]


def families_of(text: str) -> list[int]:
    h = shingle_hashes(text)
    return [int((h * np.uint64(k)).min().view(np.int64)) for k in FAMILIES] if len(h) else [0] * len(FAMILIES)


def one_of_each_family(rows: DataFrame) -> DataFrame:
    """rows (text, label) without near copies: a row stays where it comes first, by a hash of the row, in each of its
    families; of equal rows one stays."""

    @F.pandas_udf("array<long>")
    def families(texts: pd.Series) -> pd.Series:
        return texts.map(families_of)

    own = F.xxhash64("text", "label")
    named = saved(rows.select("text", "label", own.alias("row")).withColumn("families", families("text")))
    firsts = named.select("label", "row", F.posexplode("families")).groupBy("label", "pos", "col").agg(F.min("row").alias("row"))
    kept = firsts.groupBy("label", "row").agg(F.count("*").alias("n")).where(F.col("n") == len(FAMILIES)).select("row")
    return named.join(kept, "row", "left_semi").groupBy("row", "label").agg(F.min("text").alias("text")).select("text", "label")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, pos, neg): rows of (text, label) of either label that hold a word, or a word's beginning."""

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(terms_of)

    found = rows.select("label", F.explode(terms("text")).alias("term"))
    return found.groupBy("term").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


Term = tuple[str, bool, float]


def choose_terms(counts: list[tuple[str, bool, int, int]], positives: int, negatives: int) -> list[Term]:
    """(term, stem, weight) of (term, stem, pos, neg): by falling difference of the two shares of families, a term unless
    it begins a kept one or a kept stem begins it; a word before its stem and a longer stem before a shorter at equal
    difference. The weight is the log of the shares' ratio."""
    ranked = sorted(counts, key=lambda c: (-(c[2] / positives - c[3] / negatives), c[1], -len(c[0]), c[0]))
    kept: list[Term] = []
    begins: set[str] = set()
    stems: set[str] = set()
    for term, stem, pos, neg in ranked:
        if term in begins or any(term[:n] in stems for n in STEM_SIZES):
            continue
        kept.append((term, stem, math.log(pos / positives / ((neg + 0.5) / negatives))))
        begins.update(term[:n] for n in range(1, len(term) + 1))
        if stem:
            stems.add(term)
    return kept


def learn_terms(rows: DataFrame, positives: int, negatives: int) -> list[Term]:
    """The terms of rows (text, label) that pass EVIDENCE and RATIO; their number is bounded by the sample."""
    n = positives + negatives
    held = F.col("pos") + F.col("neg")

    def cell(seen, row, column):  # observed times log of observed over expected
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    pos, neg, without = F.col("pos"), F.col("neg"), n - held
    ratio = 2 * (cell(pos, held, positives) + cell(neg, held, negatives) + cell(positives - pos, without, positives) + cell(negatives - neg, without, negatives))
    apart = term_counts(rows).where((F.col("pos") * negatives >= RATIO * positives * F.col("neg")) & (ratio >= EVIDENCE))
    stem = F.col("term").endswith(STEM)
    return choose_terms([tuple(r) for r in apart.select(F.rtrim(F.translate("term", STEM, " ")), stem, "pos", "neg").collect()], positives, negatives)


class Lexicon:
    """Trie of terms intersected with their Levenshtein automata; deterministic states are made when first met.

    A state is a set of (trie node, errors so far), closed under skipping letters of the trie. A node knows the largest
    error budget of the terms below it, so hopeless members are dropped at once.
    """

    def __init__(self, terms: list[Term]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.weight: list[float] = [0.0]
        self.budget = [0]
        for term, stem, weight in terms:
            allowed, node = self.errors(term, stem), 0
            self.budget[0] = max(self.budget[0], allowed)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    for x, v in ((self.next, {}), (self.word, -1), (self.stem, -1), (self.weight, 0.0), (self.budget, 0)):
                        x.append(v)
                node = self.next[node][c]
                self.budget[node] = max(self.budget[node], allowed)
            (self.stem if stem else self.word)[node] = allowed
            self.weight[node] = max(self.weight[node], weight)
        self.states: dict[frozenset, tuple[dict, int]] = {}
        self.start = self.state({0: 0})

    @staticmethod
    def errors(term: str, stem: bool) -> int:
        return (len(term) >= 6) * 1 if stem else (len(term) >= 5) + (len(term) >= 9)

    def state(self, members: dict[int, int]) -> tuple[dict, int, frozenset]:
        todo = list(members.items())
        while todo:
            node, e = todo.pop()
            for child in self.next[node].values():
                if e + 1 <= self.budget[child] and e + 1 < members.get(child, 99):
                    members[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(members.items())
        if key not in self.states:
            best = lambda kind: min(((e, -self.weight[n]) for n, e in key if kind[n] >= e), default=None)
            self.states[key] = ({}, best(self.word), key, best(self.stem))
        return self.states[key]

    def step(self, state: tuple, c: str) -> tuple:
        members: dict[int, int] = {}

        def add(node: int, e: int) -> None:
            if e <= self.budget[node] and e < members.get(node, 99):
                members[node] = e

        for node, e in state[2]:
            add(node, e + 1)
            for label, child in self.next[node].items():
                add(child, e + (label != c))
        return self.state(members)

    def match(self, word: str) -> tuple[int, float] | None:
        """Fewest errors, and the weight, of a term that the word is or of a stem that it begins with."""
        state, best = self.start, None
        for c in word:
            nxt = state[0].get(c)
            if nxt is None:
                nxt = state[0][c] = self.step(state, c)
            state = nxt
            if not state[2]:
                break
            if state[3] is not None and (best is None or state[3] < best):
                best = state[3]
        if state[1] is not None and (best is None or state[1] < best):
            best = state[1]
        return None if best is None else (best[0], -best[1])


class Scanner:
    """Features of texts; remembers which words are clean and which hit."""

    def __init__(self, terms: list[Term]):
        self.lexicon, self.clean, self.hits = Lexicon(terms), set(), {}

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        words = WORD.findall(low)
        new = set(words) - self.clean
        found = False
        for w in new:
            if w not in self.hits:
                hit = self.lexicon.match(w)
                if hit is None:
                    self.clean.add(w)
                    continue
                self.hits[w] = hit
            found = True
        if len(self.clean) > 400_000:
            self.clean.clear()
        if not found:
            return [0.0] * FEATURES
        spots = [m.span() for m in WORD.finditer(low)]
        sums = [0.0] * FEATURES
        for i, w in enumerate(words):
            if w not in self.hits:
                continue
            quoted, factor = self.context(low, words, spots, i)
            errors, weight = self.hits[w]
            sums[errors > 0] += factor * weight
            sums[2 + (errors > 0)] += quoted
        return [*np.log1p(sums[:4]), math.sqrt(sums[0] / len(words)), float(sums[0] > 0)]

    @staticmethod
    def context(low: str, words: list[str], spots: list[tuple[int, int]], i: int) -> tuple[bool, float]:
        """Whether hit i is quoted, and what it counts."""
        first, last = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        before, after = low[spots[first][0] : spots[i][0]], low[spots[i][1] : spots[last - 1][1] + 1]
        quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        near = words[first:last]
        reported, addressed = not REPORT.isdisjoint(near), not ADDRESS.isdisjoint(near)
        return quoted, (0.25 if quoted else 1.0) * (0.5 if reported and quoted else 1.0) * (1.5 if addressed and not quoted else 1.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Weights with the bias last, by Newton steps on the ridge-penalised likelihood."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w)) * len(y) / 100
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[Term], list[float]]:
    """Terms and weights from docs (doc_id, text) and labels (doc_id, label). At most about `sample` rows of each label are
    used, chosen by a hash of doc_id; beside the terms, the driver gets one row of features for each of them."""
    rows = saved(labelled_sample(docs, labels, sample).select("text", "label"))
    apart = saved(one_of_each_family(rows))
    sizes = {r["label"]: r["count"] for r in apart.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return [], []
    terms = learn_terms(apart, sizes[1], sizes[0])
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(shared.value)
        for texts in batches:
            yield pd.Series([scanner.features(t) for t in texts])

    got = sorted((r["label"], *r["x"]) for r in rows.select("label", features("text").alias("x")).collect())
    table_ = np.array(got, dtype=float)
    return terms, fit_logistic(table_[:, 1:], table_[:, 0]).tolist()


def score_toxicity(docs: DataFrame, terms: list[Term], weights: list[float]) -> DataFrame:
    """docs with `toxicity` from 0 to 1; it takes the place of a column of that name, other columns stay."""
    if not weights:
        return docs.withColumn("toxicity", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((terms, np.array(weights)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, w = shared.value
        scanner = Scanner(terms)
        for texts in batches:
            x = np.array([scanner.features(t) for t in texts]).reshape(-1, FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))
        del scanner
        release()

    return docs.withColumn("toxicity", score("text"))


def query(spark, sf_dir):
    """op3: toxicity of every document, learned outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = held_out(F.col("doc_id"), 4, 2)
    known = labels.where(~fold).select("doc_id", F.col("toxic").alias("label"))
    scored = score_toxicity(docs, *train(docs, known))
    return scored.select("doc_id", fold.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))
