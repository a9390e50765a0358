"""Approximate nearest neighbours by additive quantisation, with exact distances for what is returned.

Training. On a bounded sample, CODEBOOKS codebooks of WORDS full-dimensional words are fitted one after the other, each by
k-means to what the earlier ones leave.

Encoding. Every vector is encoded as the sum of one word of each codebook, found by a beam search that keeps BEAM partial
sums; its codes, the squared norm of its reconstruction and its distance from it are stored with it, chunk by chunk.

Search. Queries go in blocks of a bounded size, which every task gets; the stored vectors stay where they are. Inner products
of a query with all words are a table, and the distance to a reconstruction is its stored norm less twice the sum of the
codes' entries. A task keeps the k nearest of each query so far. The first vectors of a task are those nearest by codes, compared
exactly, in double precision; from then on the k-th distance so far is a bound, and every vector whose distance to its
reconstruction does not rule it out (triangle inequality) is compared exactly too. So a task gives its true k nearest, ties
to the smaller id, whatever the table's size and however many vectors are equal; those are merged by rank.

Null, zero, and non-finite vectors and those with a null component take no part, and neither do vectors of another length
than the most common one. With fewer candidates than asked for, all are returned. A repeated id is a candidate for each of
its rows, but not for its own query, which is one: the least of its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SHARE, saved, share_limit, table

CODEBOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors of the training sample, at most about; vectors of a chunk; bytes of a block of queries.
SAMPLE, CHUNK, BLOCK = 10_000, 8_192, 1 << 23
#: Vectors of a chunk that are compared exactly before the others are ruled out.
KEEP = 600


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): finite vectors that are not zero, of the most common length."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL").where(whole)
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((words**2).sum(axis=1) - 2 * x @ words.T, axis=1)
        sums, n = np.zeros_like(words), np.bincount(near, minlength=len(words))
        np.add.at(sums, near, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def train(sample: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS) -> np.ndarray:
    """(codebooks, words, dimensions); a sample smaller than a codebook repeats its last word."""
    rng, left, out = np.random.default_rng(5), sample.astype(np.float32), []
    for _ in range(codebooks):
        book = kmeans(left, words, rng)
        left = left - book[np.argmin((book**2).sum(axis=1) - 2 * left @ book.T, axis=1)]
        out.append(np.vstack([book, np.repeat(book[-1:], words - len(book), axis=0)]))
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, codebooks) codes, and (n,) squared norms of the reconstructions and distances from them, by beam search over
    partial sums."""
    n = len(x)
    left = x.astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), dtype=np.uint8)
    for book in books:
        cost = ((left**2).sum(axis=2)[:, :, None] + (book**2).sum(axis=1) - 2 * left @ book.T).reshape(n, -1)
        width = min(beam, cost.shape[1])
        best = np.argpartition(cost, width - 1, axis=1)[:, :width]
        parent, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        left = left[rows, parent] - book[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
    pick = np.argmin((left**2).sum(axis=2), axis=1)
    rows = np.arange(n)
    codes = codes[rows, pick]
    made = sum(book[codes[:, i]].astype(float) for i, book in enumerate(books))
    return codes, (made**2).sum(axis=1), np.sqrt(((x - made) ** 2).sum(axis=1))


def encoded_chunks(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(ids, codes, norms, errors, vectors): each row has up to CHUNK vectors as packed arrays."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    names, kinds = ("ids", "codes", "norms", "errors", "vectors"), ("<i8", "u1", "<f8", "<f8", "<f8")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({name: [np.concatenate(c).astype(kind).tobytes()] for name, kind, c in zip(names, kinds, zip(*parts, strict=True), strict=True)})

        for pdf in batches:
            for at in range(0, len(pdf), CHUNK // 8):
                part = pdf.iloc[at : at + CHUNK // 8]
                x = np.stack(part["v"].to_numpy())
                parts.append((part["vec_id"].to_numpy(), *encode(x, shared.value), x))
                held += len(part)
                if held >= CHUNK:
                    yield row()
                    parts, held = [], 0
        if held:
            yield row()

    return vectors.mapInPandas(pack, ", ".join(f"{name} binary" for name in names))


def true_nearest(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distances of the k nearest of x to q by (distance, row); the sum runs over the components in order."""
    d2 = ((x - q) ** 2).sum(axis=1)
    near = np.flatnonzero(d2 <= np.partition(d2, k - 1)[k - 1] * (1 + 1e-9)) if len(d2) > k else np.arange(len(d2))
    d = np.sqrt(np.cumsum((x[near] - q) ** 2, axis=1)[:, -1])
    best = np.argsort(d, kind="stable")[:k]
    return near[best], d[best]


def search_chunk(q: np.ndarray, own: int, chunk: tuple[np.ndarray, ...], flat: np.ndarray, books: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest to q, as ids and distances, of those in `best` and of a chunk's vectors but those of id `own`."""
    ids, norms, errors, x = chunk
    table, square = (books @ q).ravel(), q @ q
    coded = norms - 2 * table[flat].sum(axis=1) + square
    coded[ids == own] = np.inf
    if len(best[0]) == k:
        limit = best[1][-1]
    else:
        first = np.argpartition(coded, keep - 1)[:keep] if len(coded) > keep else np.arange(len(coded))
        first = first[np.isfinite(coded[first])]
        limit = true_nearest(x[first], q, k)[1][-1] if len(first) >= k else np.inf
    slack = 1e-6 * np.sqrt(square + norms)  # far above the rounding of coded
    rows = np.flatnonzero((np.sqrt(np.maximum(coded, 0)) - errors <= limit + slack) & np.isfinite(coded))
    if not len(rows):
        return best
    near, distance = true_nearest(x[rows], q, k)
    both, d = np.concatenate([best[0], ids[rows[near]]]), np.concatenate([best[1], distance])
    order = np.lexsort((both, d))[:k]
    return both[order], d[order]


def scan(chunks: DataFrame, asked: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int, keep: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each query, of ids `asked`, in each task, found through the codes and exact."""
    shared = chunks.sparkSession.sparkContext.broadcast((asked, queries, books))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, queries, books = shared.value
        books = books.astype(float)
        m, words, d = books.shape
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(asked)
        for pdf in batches:
            for row in zip(*(pdf[c] for c in ("ids", "codes", "norms", "errors", "vectors")), strict=True):
                ids, codes, norms, errors, x = map(np.frombuffer, row, ("<i8", "u1", "<f8", "<f8", "<f8"))
                order = np.argsort(ids, kind="stable")  # ids rise, so ties keep the smaller
                chunk = ids[order], norms[order], errors[order], x.reshape(-1, d)[order]
                flat = codes.reshape(-1, m)[order].astype(np.int32) + np.arange(m, dtype=np.int32) * words
                best = [search_chunk(q, own, chunk, flat, books, b, k, keep) for own, q, b in zip(asked, queries, best, strict=True)]
        if sum(len(b[0]) for b in best):
            sizes = [len(b[0]) for b in best]
            yield pd.DataFrame({"query_id": np.repeat(asked, sizes), "vec_id": np.concatenate([b[0] for b in best]), "score": np.concatenate([b[1] for b in best])})

    return chunks.mapInPandas(score, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, keep: int = KEEP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors (vec_id, v) to each of queries (vec_id, v)."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = vectors.count()
    if not n:
        return none
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(SHARE)) < share_limit(SAMPLE, n)).orderBy("vec_id").toPandas()
    sample = sample if len(sample) else vectors.limit(SAMPLE).toPandas()
    books = train(np.stack(sample["v"].to_numpy()))
    chunks = saved(encoded_chunks(vectors, books))
    asked = saved(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = -(-asked.count() * books.shape[2] * 8 // BLOCK)
    found = []
    for block in range(blocks):  # each is of a bounded size, whatever the number of queries
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toPandas()
        if len(part):
            near = scan(chunks, part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()), books, k, keep)
            ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
            found.append(saved(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
    return reduce(DataFrame.unionByName, found, none)


def query(spark, sf_dir):
    """op8: the 10 nearest vectors of each vector whose id is divisible by 100."""
    vectors = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return search(vectors, vectors.where("vec_id % 100 = 0"))
