"""Document quality from a linear-chain conditional random field over lines.

A text is cut into lines (long ones into pieces of about LINE characters, so every part of a text counts). A line has a
fixed number of measures: shares of letters, capitals, digits, symbols and blanks, word lengths, repeats inside the line
and agreement with the lines beside it; each measure becomes a few soft bins. The field has two labels, good and bad, with
weights for the bins of a line, of the line before and of the line after, and for each pair of neighbouring labels.
Training uses the documents' labels for their lines; forward and backward sums give the gradient of the likelihood and,
when scoring, each line's marginal. A document's quality is the mean of the marginals weighted by length, brought to a
probability by a logistic curve on whole texts of the same sample.

Null and empty texts have no line and get the share of good documents in the sample. Without labels of both kinds every
score is 0.5. Repeated rows get equal scores. score_quality keeps all columns but one named `quality`, which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, saved, table
from .toxicity import fit_logistic

#: Characters of a line piece, measures of a line, soft bins of a measure.
LINE, MEASURES, BINS = 400, 12, 5
#: Labelled rows of each label used at most, about. A training document gives all its lines up to TRAIN_LINES; a longer one
#: gives runs of RUN neighbouring lines spread over the whole of it, each line with its true neighbours' measures.
SAMPLE, TRAIN_LINES, RUN = 1_500, 512, 32
CENTRES = np.linspace(0.0, 1.0, BINS)
PIECE = re.compile(r"[^\n]{1,%d}(?:[^\s]{0,40})" % LINE)
FIELDS = MEASURES * BINS


def lines_of(text: str | None) -> list[str]:
    return [x for x in PIECE.findall(text or "") if not x.isspace()]


def measures(line: str, before: set[str], words: list[str]) -> list[float]:
    """MEASURES numbers from 0 to 1."""
    n, k = len(line), max(1, len(words))
    letters = sum(map(str.isalpha, line))
    upper = sum(map(str.isupper, line))
    digits = sum(map(str.isdigit, line))
    blanks = line.count(" ") + line.count("\t")
    plain = sum(map(line.count, ",.;:'\"-?()"))
    other = n - letters - digits - blanks - plain
    kinds = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = len({w[-1] for w in words})
    return [
        letters / n,
        upper / max(1, letters),
        digits / n,
        min(1.0, 4 * max(0, other) / n),
        min(1.0, sum(map(len, words)) / k / 12),
        kinds / k,
        same / k,
        min(1.0, n / LINE),
        len(before & set(words)) / max(1, kinds),
        min(1.0, 3 * sum(not w[-1].isalnum() for w in words) / k / 2),
        min(1.0, max(map(words.count, set(words[:40])), default=0) / k) if words else 0.0,
        min(1.0, ends / k),
    ]


def triples(lines: list[str]) -> np.ndarray:
    """(lines, 3 * MEASURES): measures of each line, of the one before and of the one after; -9, in no bin, for none."""
    raw, before = [], set()
    for x in lines:
        words = x.split()
        raw.append(measures(x, before, words))
        before = set(words)
    own, none = np.array(raw, dtype=np.float32), np.full((1, MEASURES), -9, dtype=np.float32)
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])])


def binned(m: np.ndarray) -> np.ndarray:
    """Soft bins of measures in the last axis, and a constant."""
    bins = np.maximum(0, 1 - np.abs(m[..., None].astype(float) - CENTRES) * (BINS - 1)).reshape(*m.shape[:-1], -1)
    return np.concatenate([bins, np.ones((*m.shape[:-1], 1))], axis=-1)


def emissions(lines: list[str]) -> np.ndarray:
    """(lines, 3 * FIELDS + 1)."""
    return binned(triples(lines))


def training_runs(lines: list[str], most: int = TRAIN_LINES) -> list[np.ndarray]:
    """triples of all lines, or, above `most`, of most / RUN runs of neighbours spread from the first line to the last."""
    if not lines:
        return []
    found = triples(lines)
    if len(found) <= most:
        return [found]
    return [found[at : at + RUN] for at in np.linspace(0, len(found) - RUN, most // RUN).astype(int)]


@dataclass
class Field:
    """Weights: `line` is added to the score of label good, `pair` to that of each pair of neighbouring labels."""

    line: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    bias: float = 0.0
    prior: float = 0.5

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the summed P of each pair of neighbours."""
        score = np.zeros((len(x), 2))
        score[:, 1] = x @ self.line
        n = len(x)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = score[0]
        for i in range(1, n):
            forward[i] = score[i] + np.logaddexp(forward[i - 1, 0] + self.pair[0], forward[i - 1, 1] + self.pair[1])
        for i in range(n - 2, -1, -1):
            ahead = score[i + 1] + backward[i + 1]
            backward[i] = np.logaddexp(self.pair[:, 0] + ahead[0], self.pair[:, 1] + ahead[1])
        total = np.logaddexp(forward[-1, 0], forward[-1, 1])
        good = np.exp(forward[:, 1] + backward[:, 1] - total)
        pairs = np.zeros((2, 2))
        if n > 1:
            joint = forward[:-1, :, None] + self.pair + (score[1:] + backward[1:])[:, None, :] - total
            pairs = np.exp(joint).sum(axis=0)
        return good, pairs

    def mean_good(self, text: str | None) -> float | None:
        lines = lines_of(text)
        if not lines:
            return None
        good, _ = self.marginals(emissions(lines))
        weights = np.array([len(x) for x in lines], dtype=float)
        return float(good @ weights / weights.sum())

    def score(self, text: str | None) -> float:
        mean = self.mean_good(text)
        if mean is None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.slope * mean + self.bias, -30, 30))))


def fit(runs: list[np.ndarray], labels: list[int], weights: list[float], rounds: int = 60, rate: float = 0.15, ridge: float = 1e-4) -> Field:
    """Maximum likelihood by Adam over whole passes from runs of triples; every line of a run has the run's label.

    Runs of like length are padded to one length, so that a pass is a few products for each such group; soft bins are made
    anew in each pass, so memory follows the measures.
    """
    size, field = 3 * FIELDS + 1, Field(np.zeros(3 * FIELDS + 1), np.zeros((2, 2)))
    order = sorted(range(len(runs)), key=lambda k: len(runs[k]))
    groups, at = [], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(runs[order[end]]) * (end + 1 - at) <= 8_192:
            end += 1
        own = order[at:end]
        m = np.full((len(own), len(runs[own[-1]]), 3 * MEASURES), -9, dtype=np.float32)
        for row, k in enumerate(own):
            m[row, : len(runs[k])] = runs[k]
        groups.append((m, np.array([len(runs[k]) for k in own]), np.array([labels[k] for k in own]), np.array([weights[k] for k in own])))
        at = end
    theta, m1, m2 = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for t in range(1, rounds + 1):
        field.line, field.pair = theta[:size], theta[size:].reshape(2, 2)
        g = sum(_gradient(field, *group) for group in groups) - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    field.line, field.pair = theta[:size], theta[size:].reshape(2, 2)
    return field


def _gradient(field: Field, m: np.ndarray, n: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the log-likelihood, by forward and backward sums, of runs padded to one length: n lines each, label y,
    weight w."""
    x, pair = binned(m), field.pair
    rows, longest = m.shape[:2]
    mask = np.arange(longest) < n[:, None]
    score = np.zeros((rows, longest, 2))
    score[:, :, 1] = x @ field.line
    f, b = np.zeros_like(score), np.zeros_like(score)
    f[:, 0] = score[:, 0]
    for i in range(1, longest):
        f[:, i] = score[:, i] + np.logaddexp(f[:, i - 1, :1] + pair[0], f[:, i - 1, 1:] + pair[1])
    for i in range(longest - 2, -1, -1):
        ahead = score[:, i + 1] + b[:, i + 1]
        b[:, i] = np.where(mask[:, i + 1, None], np.logaddexp(pair[:, 0] + ahead[:, :1], pair[:, 1] + ahead[:, 1:]), 0.0)
    end = f[np.arange(rows), n - 1]
    total = np.logaddexp(end[:, 0], end[:, 1])
    good = np.exp(np.where(mask, f[:, :, 1] + b[:, :, 1] - total[:, None], -1e9))
    line = np.tensordot((y[:, None] * mask - good) * w[:, None], x, axes=([0, 1], [0, 1]))
    both = mask[:, 1:, None, None]
    joint = np.exp(np.where(both, f[:, :-1, :, None] + pair + (score + b)[:, 1:, None, :] - total[:, None, None, None], -1e9))
    seen = np.zeros((rows, 2, 2))
    seen[np.arange(rows), y, y] = n - 1
    return np.concatenate([line, ((seen - joint.sum(axis=1)) * w[:, None, None]).sum(axis=0).ravel()])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field from docs (doc_id, text) and labels (doc_id, label): at most about `sample` rows of each label, chosen by a
    hash of doc_id. The driver gets the measures of the lines that training_runs gives, and one mean of whole-text
    marginals for each row, on which the final curve is fitted. Both labels weigh the same."""
    rows = saved(labelled_sample(docs, labels, sample))

    @F.pandas_udf("array<binary>")
    def runs_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [x.tobytes() for x in training_runs(lines_of(t))])

    got = sorted(rows.select("doc_id", "label", runs_of("text").alias("runs")).collect(), key=lambda r: (r["doc_id"], r["label"]))
    got = [(r["label"], [np.frombuffer(x, dtype=np.float32).reshape(-1, 3 * MEASURES) for x in r["runs"]]) for r in got if r["runs"]]
    n = {k: sum(y == k for y, _ in got) for k in (0, 1)}
    if not n[0] or not n[1]:
        return None
    flat = [(x, y, 1 / (2 * n[y] * sum(map(len, runs)))) for y, runs in got for x in runs]
    field = fit(*map(list, zip(*flat, strict=True)))
    field.prior = n[1] / len(got)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    mean = F.pandas_udf(lambda texts: texts.map(shared.value.mean_good), "double")
    means = sorted((r["label"], r["mean"]) for r in rows.select("label", mean("text").alias("mean")).where("mean IS NOT NULL").collect())
    y, x = np.array(means).T
    field.slope, field.bias = map(float, fit_logistic(x[:, None], y, ridge=1.0))
    return field


def score_quality(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs with `quality` from 0 to 1."""
    if field is None:
        return docs.withColumn("quality", F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts])

    return docs.withColumn("quality", of("text"))


def query(spark, sf_dir):
    """op6: quality of every document, learned outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = held_out(F.col("doc_id"), 5, 0)
    known = labels.where(~fold).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(docs, train(docs, known))
    return scored.select("doc_id", fold.alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))
