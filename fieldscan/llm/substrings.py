"""Substring dedup: words covered by a window that also starts in a document with a smaller id are removed.

A window is `size` consecutive words. Four passes over partitions, each bounded by a document or a fixed table:

1. Sketch. Each window is represented by its anchor, the smallest hash among its runs of `gram` words: equal windows have
   equal anchors, and a document has some 4.5 anchors per 100 windows. A task adds each distinct anchor of a document once
   to a count-min sketch of saturating counts, kept sparse; the tasks' sketches are merged block by block. The merged count
   of an anchor is never below the number of documents that hold it, so a window in two documents always has an anchor
   estimated at two or more. The number of cells follows the bytes of text, at least CELLS for each anchor, so the share of
   windows passed in vain stays near 1 %. What tasks read is one bit for each cell; where that would be above MOST_BITS,
   the counts of anchors stay distributed and the repeated ones meet their documents in a join.
2. Candidates. Windows whose anchor is estimated to repeat are emitted with 128 bits of rolling hash, and grouped exactly:
   the smallest doc_id per window, combined before the shuffle, so a passage in a third of all rows is one row per task.
3. Windows joined with their smallest doc_id, kept as a table of repeated windows alone so that a hot one can be split, are
   removed where it is smaller than their own.
4. Places to remove meet the texts by doc_id and digest of the text.

Texts equal to the byte are one class: the document with the smallest id goes through passes 2 and 3, and in the others
every window has a smaller document, so all their words go if there are `size` of them. Null and empty texts have no words
and lose none; a text under `size` words keeps all. Rows that repeat an id are judged row by row, against ids smaller than
theirs; a null id is smaller than none and has none smaller, so its row keeps all words. Two different windows with equal
128-bit hashes are taken as equal. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved, small, table

ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: White space that parts words, \x20 and \x09-\x0D, which is also what bytes.split() takes.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Cells of a sketch row are merged in blocks of 2^BLOCK_BITS; a sketch has ROWS rows of at most 2^MOST_BITS cells each,
#: which is a bit a cell where tasks read it, so 64 MB, and CELLS cells or more for each anchor.
BLOCK_BITS, ROWS, MOST_BITS, CELLS = 18, 2, 28, 8
#: Entries that a task's sparse sketch holds before it is sent.
PENDING = 500_000
#: Bytes of text whose windows are made at once, a longer document alone, and whose words are hashed at once.
CHUNK, PART_BYTES = 1 << 19, 1 << 17


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of each span of values: a polynomial over prefix sums, modulo 2^64, that does not depend on the place."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """spans_hash of the words of a text's bytes, PART_BYTES at a time, so that a long text needs a few bytes a byte."""
    out, i = np.zeros(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PART_BYTES)))
        out[i:j] = spans_hash(data[starts[i] : ends[j - 1]].astype(np.uint64) + np.uint64(1), starts[i:j] - starts[i], ends[i:j] - starts[i], powers)
        i = j
    return out


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each `span` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= span:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - span + 1], out[span - have :]) if have < span else out


class Chunk:
    """Windows of several documents hashed together; `doc` and `start` place each window, none crosses a border."""

    def __init__(self, texts: list[bytes], size: int, gram: int, powers: list[Powers]):
        self.size, self.powers = size, powers
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        begins = np.cumsum([0, *map(len, texts)])
        solid = np.ones(len(data) + 2, dtype=bool)
        solid[0] = solid[-1] = False
        solid[1:-1] = ~BLANK[data]
        border = np.zeros(len(data) + 1, dtype=bool)
        border[begins] = True
        starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | border[:-1]))
        ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | border[1:])) + 1
        self.words = words_hash(data, starts, ends, powers[0])
        first = np.searchsorted(starts, begins)
        counts = np.diff(first)
        at = np.arange(max(0, len(self.words) - size + 1))
        doc = np.repeat(np.arange(len(texts)), counts)[: len(at)]
        inside = at + size <= first[1:][doc]
        self.at, self.doc = at[inside], doc[inside]
        self.start = self.at - first[self.doc]
        self.anchor = self.words[:0]
        if len(self.at):
            grams = spans_hash(self.words, np.arange(len(self.words) - gram + 1), np.arange(gram, len(self.words) + 1), powers[1])
            self.anchor = sliding_min(grams, size - gram + 1)[self.at]

    def runs(self) -> np.ndarray:
        """Index of each first window of a run with one document and anchor."""
        if not len(self.at):
            return self.at
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        return np.flatnonzero(new)

    def hashes(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[keep]
        return spans_hash(self.words, at, at + self.size, self.powers[2]), spans_hash(self.words, at, at + self.size, self.powers[3])


def chunks(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Rows and their windows, CHUNK bytes at a time."""
    powers = [Powers(b) for b in ODD]
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        begin = held = 0
        for k, text in enumerate(texts):
            if held and held + len(text) > CHUNK:
                yield batch.slice(begin, k - begin), Chunk(texts[begin:k], size, gram, powers)
                begin, held = k, 0
            held += len(text)
        if begin < len(texts):
            yield batch.slice(begin), Chunk(texts[begin:], size, gram, powers)


def of_document(anchors: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One number for an anchor in a document of a chunk."""
    return mix(anchors + doc.astype(np.uint64) * np.uint64(ODD[3]))


def distinct_anchors(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct anchor of each document, and the document's place in the chunk."""
    first = chunk.runs()
    anchors, doc = chunk.anchor[first], chunk.doc[first]
    once = np.sort(np.unique(of_document(anchors, doc), return_index=True)[1])
    return anchors[once], doc[once]


def cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(anchors) * np.uint64(ODD[row])) >> np.uint64(64 - bits)


def sketch_bits(n_bytes: int, size: int, gram: int) -> int:
    """Two to this are CELLS cells for each anchor of so many bytes of text, words being three letters and a blank."""
    anchors = n_bytes / 4 * 2 / (size - gram + 2)
    return max(BLOCK_BITS, int(CELLS * anchors).bit_length())


def repeated_cells(docs: DataFrame, size: int, gram: int, bits: int) -> np.ndarray:
    """ROWS x 2^bits bits: cells of the count-min sketch of all documents' anchors whose count is two or more."""
    block = 1 << BLOCK_BITS

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            anchors = np.concatenate(held)
            held.clear()
            for r in range(ROWS):
                at, n = np.unique(cells(anchors, r, bits), return_counts=True)
                edges = np.searchsorted(at, np.arange(0, (1 << bits) + 1, block, dtype=np.uint64))
                low, n = (at & np.uint64(block - 1)).astype("<u4"), np.minimum(n, 2).astype("u1")
                rows = [((r << bits) // block + k, low[i:j].tobytes(), n[i:j].tobytes()) for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "cells", "counts"])

        for _, chunk in chunks(batches, size, gram):
            held.append(distinct_anchors(chunk)[0])
            if sum(map(len, held)) > PENDING:
                yield from send()
        if sum(map(len, held)):
            yield from send()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, dtype=np.uint8)
        for at, n in zip(pdf["cells"], pdf["counts"], strict=True):  # cells of one sketch are distinct
            at = np.frombuffer(at, "<u4")
            total[at] = np.minimum(total[at] + np.frombuffer(n, "u1"), 2)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.packbits(total >= 2, bitorder="little").tobytes()]})

    merged = docs.mapInArrow(sketch, "block int, cells binary, counts binary").groupBy("block").applyInPandas(merge, "block int, bits binary")
    out = np.zeros((ROWS << bits) // 8, dtype=np.uint8).reshape(-1, block // 8)
    for r in merged.collect():  # ROWS * 2^bits / block blocks
        out[r["block"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.reshape(ROWS, -1)


def part_of(text: str) -> Column:
    """Tells apart rows of one id with different texts."""
    return F.xxhash64(text).alias("part")


def with_repeated_anchors(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """docs (doc_id, part, text) that hold an anchor which another row holds too, with `anchors`: those anchors."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, chunk in chunks(batches, size, gram):
            anchors, doc = distinct_anchors(chunk)
            edges = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(anchors.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), lists], names=["doc_id", "part", "anchors"])

    held = saved(docs.mapInArrow(listed, "doc_id long, part long, anchors array<long>")).select("doc_id", "part", F.explode("anchors").alias("anchor"))
    repeated = saved(held.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    found = held.join(repeated, "anchor").groupBy("doc_id", "part").agg(F.collect_set("anchor").alias("anchors"))
    return docs.join(found, ["doc_id", "part"])


def candidate_windows(docs: DataFrame, size: int, gram: int, most_bits: int) -> DataFrame:
    """(doc_id, part, start, h1, h2) of the windows of docs (doc_id, part, text) whose anchor is estimated in two rows or
    more."""
    bits = sketch_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, size, gram)
    if bits <= most_bits:
        sketch = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, size, gram, bits))
    else:
        sketch, docs = None, saved(with_repeated_anchors(docs, size, gram))

    def repeated(rows: pa.RecordBatch, chunk: Chunk, first: np.ndarray) -> np.ndarray:
        anchors = chunk.anchor[first]
        if sketch is None:
            own = rows.column("anchors")
            wanted = of_document(own.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(own)), own.value_lengths().to_numpy()))
            return np.isin(of_document(anchors, chunk.doc[first]), wanted)
        passed = np.ones(len(anchors), dtype=bool)
        for r in range(ROWS):
            at = cells(anchors, r, bits)
            passed &= (sketch.value[r, at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return passed

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, chunk in chunks(batches, size, gram):
            first = chunk.runs()
            if not len(first):
                continue
            keep = np.flatnonzero(np.repeat(repeated(rows, chunk, first), np.diff(np.append(first, len(chunk.at)))))
            h1, h2 = chunk.hashes(keep)
            ids = [rows.column(name).take(pa.array(chunk.doc[keep])) for name in ("doc_id", "part")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(chunk.start[keep], pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc_id", "part", "start", "h1", "h2"])

    return docs.mapInArrow(emit, "doc_id long, part long, start int, h1 long, h2 long")


def repeated_starts(docs: DataFrame, size: int = 50, gram: int = 8, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, part, starts), one row for each id and digest of a text: places (in words) of windows that a document with a
    smaller id has too, and, for a whole copy of such a document, null starts."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", part_of("text"), "text")
    classes = saved(docs.select("doc_id", "part", F.md5(F.col("text").cast("binary")).alias("class")).distinct())
    firsts = saved(classes.groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "first"))
    copies = saved(classes.join(small(firsts, firsts.count()), "class").where("doc_id > first").select("doc_id", "part"))
    left = docs.join(small(copies, copies.count()), ["doc_id", "part"], "left_anti")
    found = saved(candidate_windows(left, size, gram, most_bits))
    least = saved(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h1", "h2", "least"))
    later = found.join(least, ["h1", "h2"]).where("doc_id > least")
    starts = later.groupBy("doc_id", "part").agg(F.collect_set("start").alias("starts"))
    return starts.unionByName(copies.select("doc_id", "part", F.lit(None).cast("array<int>").alias("starts")))


def removal_mask(n: int, starts: np.ndarray | None, size: int) -> np.ndarray:
    """True for the words that windows at starts cover; None stands for every window."""
    if n < size:
        return np.zeros(n, dtype=bool)
    if starts is None:
        return np.ones(n, dtype=bool)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:n] > 0


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is what is left of each document's words, joined by one space."""
    marked = saved(repeated_starts(docs, size).withColumn("hit", F.lit(True)))
    docs = docs.select("doc_id", part_of("text"), "text")
    if marked.count() <= BROADCAST_ROWS:  # texts that keep every word stay where they are
        ids = F.broadcast(marked.select("doc_id", "part"))
        hit = docs.join(ids, ["doc_id", "part"], "left_semi").join(marked, ["doc_id", "part"])
        kept = docs.join(ids, ["doc_id", "part"], "left_anti").select("*", F.lit(None).cast("array<int>").alias("starts"), F.lit(False).alias("hit"))
        both = kept.unionByName(hit)
    else:
        both = docs.join(marked, ["doc_id", "part"], "left")
    both = both.select("doc_id", "text", "starts", F.coalesce("hit", F.lit(False)).alias("hit"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 128):  # few at once: words and places are Python objects and arrays
                part = batch.slice(first, 128)
                texts, starts, hit = part.column("text").cast(pa.binary()), part.column("starts"), part.column("hit")
                n_words, n_removed, all_kept = [], [], []
                for k in range(part.num_rows):
                    kept = words = (texts[k].as_py() or b"").split()
                    if hit[k].as_py():
                        at = starts[k].values.to_numpy().astype(np.int64) if starts[k].is_valid else None
                        gone = removal_mask(len(words), at, size)
                        kept = [w for w, g in zip(words, gone, strict=True) if not g]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(kept))
                    all_kept.append(b" ".join(kept))
                columns = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(all_kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")


def query(spark, sf_dir):
    """op5: words, removed words and a digest of what is left, per document."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM d, unnest(generate_series(0, len(w) - 50)) AS t(i) WHERE len(w) >= 50),
least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN least USING (h), unnest(generate_series(0, 49)) AS t(k) WHERE doc_id > first),
wordsof AS (SELECT doc_id, p - 1 AS p, w[p] AS word FROM d, unnest(generate_series(1, len(w))) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS txt, count(*) AS n FROM wordsof ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
