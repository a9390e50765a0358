"""How the sources of a language differ in their terms, by a frequent-pattern tree over terms.

Terms are runs of letters (everything beyond ASCII counts as a letter), A-Z lower-cased; a language keeps those that at least
MIN_DOCS of its documents hold. A group, one source of one language, gives a kept term the smoothed share p in units of 1e-9,
exactly: 1 + floor(1e9 (count + 5) / (N + 5 V)), with N occurrences of the V kept terms; z is its p of a count of none.

Pairs. The distance of two groups is the sum of abs(p - q) over all kept terms. If no term occurred it would be V times the
distance of their z. Two kinds of corrections make it exact. What one group's terms add while the other counts none follows from
the group's histogram of p, by running sums at the other's z. What terms of both add comes from the tree: each term is the path
of its (source, p) in the order of sources, equal paths are one with a multiplicity, and terms that share a beginning share
nodes. Sorted paths are the tree in the order of a walk, a node being a run of rows that begin alike; each node gives its
correction with each ancestor once, times its multiplicity. Tasks hold a batch of paths, and a node that is cut between two
batches or tasks gives its share in each.

Null text, language and source are ''. A repeated row is a document of its own. A language without kept terms has distances of
0; a group without terms still has its pairs. An empty table gives none. Columns beyond the three are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

#: Documents of a language that hold a kept term, at least; terms reported for each group; unit of the shares.
MIN_DOCS, TOP, UNIT = 30, 50, 1_000_000_000
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Terms a task holds before it sends them; bytes of a text read at once; rows of the tree worked on at once.
PENDING, SLICE, PATHS = 400_000, 1 << 22, 4_096


def slices(text: bytes) -> Iterator[bytes]:
    """A text in parts of about SLICE bytes, none cut inside a term."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and TERM.match(text, end - 1, end) and TERM.match(text, end, end + 1):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and its documents there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, list[int]]] = {}
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                n, d = zip(*terms.values(), strict=True)
                same = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            langs, sources, texts = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())
            for lang, source, text in zip(langs, sources, texts, strict=True):
                own: Counter = Counter()
                for part in slices(text.as_py().lower()):
                    own.update(TERM.findall(part))
                if not own:
                    continue
                terms = held.setdefault((lang, source), {})
                before = len(terms)
                for term, n in own.items():
                    if term in terms:
                        terms[term][0] += n
                        terms[term][1] += 1
                    else:
                        terms[term] = [n, 1]
                size += len(terms) - before
                if size >= PENDING:
                    yield from send()
                    size = 0
        yield from send()

    sent = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (n + 5) / (total + 5 kept)), exactly; null where there is no kept term."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, low = wide(F.lit(UNIT)) * wide(n + 5), wide(total + 5 * kept)
    return F.when(kept > 0, 1 + F.call_function("div", top, low))


def tree_corrections(rows: DataFrame) -> DataFrame:
    """(lang, i, j, value) of rows (lang, term, i, p, z): for groups numbered i < j, partial sums over the terms of both of
    abs(p - q) - abs(p - z of j) - abs(z of i - q) + abs(z of i - z of j)."""
    paths = rows.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("i", "p", "z"))).alias("path"))
    paths = paths.groupBy("lang", "path").agg(F.count("*").alias("n")).where(F.size("path") > 1)
    walk = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PATHS):
                part = batch.slice(at, PATHS)
                langs = part.column("lang").to_pylist()
                edges = [0, *(k for k in range(1, len(langs)) if langs[k] != langs[k - 1]), len(langs)]
                for a, b in zip(edges, edges[1:], strict=False):
                    own = part.slice(a, b - a)
                    i, j, value = node_corrections(own.column("path"), own.column("n").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array([langs[a]] * len(i), pa.string()), pa.array(i), pa.array(j), pa.array(value)], names=["lang", "i", "j", "value"])

    return walk.mapInArrow(correct, "lang string, i int, j int, value long")


def node_corrections(paths: pa.ListArray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums for each pair (i, j) of groups over the nodes of sorted paths with multiplicities n."""
    size = paths.value_lengths().to_numpy().astype(np.int64)
    depth, rows = int(size.max()), len(size)
    flat = paths.flatten()
    row = np.repeat(np.arange(rows), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    grid = {}
    for name in ("i", "p", "z"):
        grid[name] = np.full((depth, rows), -1, dtype=np.int64)
        grid[name][place, row] = flat.field(name).to_numpy()
    same = np.zeros(rows, dtype=bool)  # whether a row begins like the one before it, down to here
    same[1:] = True
    codes, values, width = [], [], int(grid["i"].max()) + 1
    for d in range(depth):
        same[1:] &= (grid["i"][d, 1:] == grid["i"][d, :-1]) & (grid["p"][d, 1:] == grid["p"][d, :-1])
        first = np.flatnonzero(~same)
        times = np.add.reduceat(n, first)
        there = grid["i"][d, first] >= 0
        first, times = first[there], times[there]
        j, q, zq = (grid[name][d, first] for name in ("i", "p", "z"))
        for a in range(d):
            i, p, zp = (grid[name][a, first] for name in ("i", "p", "z"))
            codes.append(i * width + j)
            values.append(times * (np.abs(p - q) - np.abs(p - zq) - np.abs(zp - q) + np.abs(zp - zq)))
    if not codes:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(code), dtype=np.int64)
    np.add.at(total, at, np.concatenate(values))
    return (code // width).astype(np.int32), (code % width).astype(np.int32), total


def single_corrections(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, value), i < j: what the terms of one group add to its distance from another that has none of them."""
    histogram = rows.groupBy("lang", "i", "p").agg(F.count("*").alias("n"))
    held = histogram.select("lang", "i", F.col("p").alias("x"), "n", (F.col("n") * F.col("p")).alias("s"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("long").alias("z"))
    other = groups.select("lang", F.col("i").alias("j"), F.col("z").alias("x"))
    asks = groups.select("lang", "i", "z").join(other, "lang").where("i <> j").select("lang", "i", "x", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), "j", "z")
    both, x = held.unionByName(asks), F.col("x")
    group = W.partitionBy("lang", "i")
    below = group.orderBy("x").rangeBetween(W.unboundedPreceding, W.currentRow)
    n, s = F.sum("n").over(below), F.sum("s").over(below)
    moved = x * n - s + (F.sum("s").over(group) - s) - x * (F.sum("n").over(group) - n)
    value = moved - F.sum("n").over(group) * F.abs(F.col("z") - x)
    found = both.withColumn("value", value).where("j IS NOT NULL")
    return found.select("lang", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance from every other source of the language (part
    'pair') and the `top` terms it has most above the language's share (part 'term')."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = saved(term_counts(docs))
    kept = saved(counts.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "whole"))
    rows = counts.drop("docs").join(kept, ["lang", "term"])
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_total"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", none("total"), none("kept"), none("lang_total"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("total", "source"))  # small groups share more of the tree
    groups = saved(groups.withColumn("i", number).withColumn("z", share(F.lit(0), F.col("total"), F.col("kept"))))
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("whole"), F.col("lang_total"), F.col("kept"))
    rows = saved(rows.join(groups, ["lang", "source"]).select("lang", "source", "term", "i", "z", p.alias("p"), q.alias("q")))

    ends = lambda side: groups.select("lang", F.col("i").alias(side), F.col("source").alias(f"source_{side}"), F.col("z").alias(f"z_{side}"), *(["kept"] if side == "i" else []))
    corrections = tree_corrections(rows).unionByName(single_corrections(rows, groups.where("kept > 0"))).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    pairs = ends("i").join(ends("j"), "lang").where("i < j").join(corrections, ["lang", "i", "j"], "left")
    value = F.coalesce(F.col("kept") * F.abs(F.col("z_i") - F.col("z_j")) + F.coalesce("value", F.lit(0)), F.lit(0))
    both = F.explode(F.array(F.struct(F.col("source_i").alias("source"), F.col("source_j").alias("item")), F.struct(F.col("source_j").alias("source"), F.col("source_i").alias("item"))))
    pairs = pairs.select("lang", both.alias("e"), value.alias("value")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    terms = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def query(spark, sf_dir):
    """op11: distances between the sources of each language, and the terms each has most above its language."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS whole FROM tok GROUP BY ALL HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(whole)::HUGEINT AS total FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS (
  SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (whole + 5)) // (total + 5 * v))::BIGINT AS q
  FROM g JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(v, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS v FROM p x JOIN p y USING (lang, term) GROUP BY ALL) w ON w.lang = a.lang AND w.s = a.source AND w.t = b.source),
term AS (
  SELECT lang, source, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS r FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT lang, source, 'term', item, value, CAST(r AS INTEGER) FROM term WHERE r <= 50
"""
