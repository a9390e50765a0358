"""SimHash near-duplicates: fingerprints of word shingles, linked through Golay-code keys.

Fingerprint. A text gives the XXH64 of each shingle of `width` consecutive words, repeats included; bit b is set when
more than half of the hashes have it.

Links. A fingerprint is cut into three segments of at most 23 bits. The binary Golay code [23,12,7] is perfect: each
23-bit word has one codeword within distance 3. A segment is decoded to the 12-bit index of that codeword, and, when the
codeword is at distance 3, also to those of the five codewords at distance 4. Two segments that differ in one bit always
share an index. When two fingerprints differ in at most two bits, the pigeonhole leaves one segment equal whose successor
(in the order 1, 2, 3, 1) differs in at most one bit; so a key of (exact segment, index of its successor) is shared.
Fingerprints that share a key are verified on the full 64 bits.

A key with many fingerprints is not paired: inside it, two fingerprints within two bits share a word at most one bit from
each, so each emits itself and its one-bit neighbours and those with a common word are linked in a star. This is exact
and linear in the bucket. Components come from rounds of min-label stars over distinct fingerprints.

Null and empty texts have no words and fingerprint 0, which is linked like any other. Equal fingerprints are one node,
so thousands of copies cost one row in the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, TEXT_BATCH, UPPER, release, saved, small, table

FOLD = str.maketrans(UPPER, LOWER)
#: ASCII white space that parts words: \x20 and \x09-\x0D.
BLANKS = str.maketrans({c: " " for c in "\t\n\v\f\r"})
SEED = 42
#: Low bit and bits of each segment of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Members of a key up to which all pairs in it are verified.
PAIR_LIMIT = 48
#: near_copies: words of a shingle, bands of least hashes, and hashes of a band.
SHINGLE, BANDS, ROWS = 5, 30, 5
#: near_copies: cells in which shingles are counted to order them, and the ratio of sizes within a bucket.
CELLS, SIZE_STEP = 1 << 17, 1.1


def words(text: str) -> list[str]:
    return [w for w in text.translate(BLANKS).split(" ") if w]


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64-bit majority of unsigned 64-bit hashes, counted in blocks so that memory stays bounded."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        block = np.ascontiguousarray(hashes[at : at + 4096]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def text_fingerprint(text: str | None, width: int = 3) -> int:
    import xxhash

    w = words((text or "").translate(FOLD))
    if not w:
        return 0
    shingles = map(" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) > width else [" ".join(w)]
    hash64 = xxhash.xxh64_intdigest
    return fingerprint(np.fromiter((hash64(s, SEED) for s in shingles), dtype=np.uint64))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([text_fingerprint(t, width) for t in batch], dtype=np.uint64).view(np.int64))
        release()

    return docs.select("doc_id", of("text").alias("fp"))


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome (11 bits): the coset leader of weight at most 3; and the words of weight 4 in cosets whose leader has
    weight 3 (five each; -1 elsewhere)."""
    light = np.array([sum(1 << b for b in bits) for k in range(5) for bits in combinations(range(23), k)], dtype=np.int64)
    syn, w = syndrome(light), np.bitwise_count(light)
    leader = np.zeros(2048, dtype=np.int64)
    leader[syn[w <= 3]] = light[w <= 3]
    fours = np.full((2048, 5), -1, dtype=np.int64)
    for s in np.flatnonzero(np.bitwise_count(leader) == 3):
        fours[s] = light[(syn == s) & (w == 4)]
    return leader, fours


def syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of the word as a polynomial over GF(2) by the generator."""
    left = word.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where((left >> bit) & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


def indices(segment: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, 6) indices of the codewords near each segment; -1 where there is none. The code is systematic in the upper
    12 bits, so those are the index."""
    leader, fours = tables
    s = syndrome(segment)
    out = np.full((len(segment), 6), -1, dtype=np.int64)
    out[:, 0] = (segment ^ leader[s]) >> 11
    out[:, 1:] = np.where(fours[s] >= 0, (segment[:, None] ^ fours[s]) >> 11, -1)
    return out


def golay_keys(nodes: DataFrame) -> DataFrame:
    """(view, fp, key): the keys of each distinct fingerprint of a view, 16 on average."""
    schema = "view int, fp long, key long"

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = golay_tables()
        for pdf in batches:
            fp, view = pdf["fp"].to_numpy(), pdf["view"].to_numpy()
            part = [(fp.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits in SEGMENTS]
            out = []
            for i in range(3):
                near = indices(part[(i + 1) % 3], tables)
                key = ((((view.astype(np.int64) << 22 | part[i])[:, None] << 12) | near) << 2) | i
                row, col = np.nonzero(near >= 0)
                out.append(pd.DataFrame({"view": view[row], "fp": fp[row], "key": key[row, col]}))
            yield pd.concat(out)
        release()

    return nodes.select("view", "fp").mapInPandas(make, schema)


def links(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """(view, a, b), a < b: verified links between distinct fingerprints of one view; within a full key, a star for each
    common word. Keys and stars are exact for two bits or fewer, so more are refused."""
    if bits > 2:
        raise ValueError("links are exact up to 2 bits")
    keyed = golay_keys(nodes)  # made twice: cheaper than keeping 16 rows for each fingerprint
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(keyed.join(shared, "key"))
    few = members.where(F.col("n") <= PAIR_LIMIT).groupBy("key").agg(F.first("view").alias("view"), F.collect_list("fp").alias("fps"))
    near = lambda x: F.filter("fps", lambda y: (y > x) & (F.bit_count(y.bitwiseXOR(x)) <= bits))
    paired = F.flatten(F.transform("fps", lambda x: F.transform(near(x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = few.select("view", F.explode(paired).alias("p")).select("view", "p.a", "p.b")
    flips = F.array(*[F.lit(0).cast("long")], *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    full = members.where(F.col("n") > PAIR_LIMIT).select("key", "view", "fp", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("middle"))
    centre = full.groupBy("key", "middle").agg(F.min("fp").alias("a"))
    stars = full.join(centre, ["key", "middle"]).where("a < fp").select("view", "a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable. Large-star and small-star rounds until no edge changes."""
    edges = saved(edges.select("a", "b"))
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select("b", "m").where("b != m").distinct()
        low = large.groupBy("b").agg(F.min("m").alias("low"))
        step = large.join(low, "b")
        small_star = step.select(F.col("low").alias("a"), F.col("b")).unionByName(step.where("m != low").select(F.col("low").alias("a"), F.col("m").alias("b"))).distinct()
        edges = saved(small_star)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most `bits` (2) bits."""
    prints = saved(fingerprints(docs, width), batch=TEXT_BATCH)
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = saved(components(links(nodes.withColumn("view", F.lit(0)), bits)))
    named = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = saved(named)
    firsts = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(firsts, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each distinct shingle of `width` words, rising; of all words where there are fewer. Empty without a word."""
    import xxhash

    w = (text or "").translate(FOLD).encode().split()
    shingles = {b" ".join(w)} if w and len(w) < width else set(map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles)))


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key for each of BANDS bands: the ROWS least values that as many mixings of the hashes take, as one number."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 1024):
        mixed = h[at : at + 1024, None] * odd
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, mixed.min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def shingle_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, class, size, keys): the digest of the text, how many distinct shingles it has, and its band keys, none
    without a word."""

    @F.pandas_udf("size int, keys array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            hashes = [shingle_hashes(t) for t in batch]
            yield pd.DataFrame({"size": [len(h) for h in hashes], "keys": [band_keys(h) if len(h) else np.array([], dtype=np.int64) for h in hashes]})
        release()

    return docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("class"), of("text").alias("k")).select("doc_id", "class", "k.size", "k.keys")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set): the shingle hashes of the texts whose doc_id is a `node` of wanted; other texts are read and left."""

    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingle_hashes(t).view(np.int64) for t in batch])
        release()

    named = docs.select(F.col("doc_id").alias("node"), "text").join(small(wanted, wanted.count()), "node", "left_semi")
    return saved(named.select("node", of("text").alias("set")).distinct(), batch=TEXT_BATCH)


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets have at least this Jaccard similarity, all compared in full."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return saved(both.where(common / (F.size("set_a") + F.size("set_b") - common) >= similarity).select("a", "b"))


def least_common(n: int, m: int, similarity: float) -> int:
    """Shingles that sets of n and m have in common at least if their Jaccard similarity is this."""
    return math.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def prefix_keys(h: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set's necessary prefixes, and the rank of the shingle of each. Shingles are ranked by their counts, rarest
    first. For each bucket of sizes that a similar set may have, the prefix is as long as the smallest such size asks for;
    a key is a shingle with both buckets."""
    order = np.lexsort((h, counts[(h % np.uint64(len(counts))).astype(np.int64)]))
    bucket = lambda n: int(math.log(n) / math.log(SIZE_STEP) + 1e-9)
    n, keys, ranks = len(h), [], []
    low, high = math.ceil(similarity * n - 1e-9), int(n / similarity + 1e-9)
    for b in range(bucket(low), bucket(high) + 1):
        size = max(low, math.ceil(SIZE_STEP**b - 1e-6))
        first = order[: max(0, n - least_common(n, size, similarity) + 1)]
        both = np.uint64((min(b, bucket(n)) << 12 | max(b, bucket(n))) * 2 + 1)
        mixed = (h[first] ^ (h[first] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + both * np.uint64(0xD6E8FEB86659FD93)
        keys.append(mixed ^ (mixed >> np.uint64(32)))
        ranks.append(np.arange(len(first)))
    return np.concatenate(keys).view(np.int64), np.concatenate(ranks)


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of nodes (node, size, label) of different labels that may have this Jaccard similarity: an exact
    prefix-filtered join with bounds on sizes and places. Sets that share only frequent shingles do not meet."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, dtype=np.int64)
        for pdf in batches:
            for x in pdf["set"]:
                np.add.at(total, (x.view(np.uint64) % np.uint64(CELLS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})
        release()

    counts = np.zeros(CELLS, dtype=np.int64)
    got = sets.select("set").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts[got["cell"].to_numpy(dtype=np.int64)] = got["n"]
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("keys array<long>, ranks array<int>")
    def keys_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [prefix_keys(x.view(np.uint64), shared.value, similarity) for x in batch]
            yield pd.DataFrame({"keys": [k for k, _ in found], "ranks": [r.astype(np.int32) for _, r in found]})
        release()

    prefixes = nodes.join(sets, "node").select("node", "size", "label", keys_of("set").alias("k"))
    rows = saved(prefixes.select("node", "size", "label", F.explode(F.arrays_zip("k.keys", "k.ranks")).alias("k")).select("node", "size", "label", F.col("k.keys").alias("key"), F.col("k.ranks").alias("rank")), batch=TEXT_BATCH)
    shared_keys = saved(rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"))
    rows = saved(rows.join(shared_keys, "key", "left_semi"))
    x, y = rows.alias("x"), rows.alias("y")
    most = F.least(F.col("x.size") - F.col("x.rank"), F.col("y.size") - F.col("y.rank"))
    needed = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("x.size") + F.col("y.size")) - 1e-9)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & (most >= needed))
    return saved(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())


def near_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) where near copies are wanted rather than one fixed fingerprint: texts that are equal, or whose
    sets of five-word shingles have a Jaccard similarity of `similarity` or more, are linked. Rows that repeat an id count
    as that id's; rows without an id are left out. An empty table gives none.

    Texts that may be linked share one of BANDS keys of ROWS least hashes each: at 0.8 a pair has none in 7 of a million
    cases. In each key, all texts are compared in full with one: the one with most company over all its keys, which is
    close to the text that a group was copied from. Keys whose texts are in one component by then are done. The texts of
    the others meet in an exact prefix-filtered join, where only texts of different components that share a rare enough
    shingle are compared. So a group of copies costs rows in proportion to its size, and no pair is left out that could
    join two components. Texts without a word are linked to their equals only.
    """
    docs = docs.where("doc_id IS NOT NULL")
    prints = saved(shingle_keys(docs), batch=TEXT_BATCH)
    classes = saved(prints.groupBy("class").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    keyed = classes.select("node", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(keyed.join(shared, "key"))
    scores = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("score"))
    scored = members.join(scores, "node")
    centres = scored.groupBy("key").agg(F.max_by(F.struct("node", "size"), F.struct("score", -F.col("node"))).alias("centre"))
    ratio = F.least("size", "centre.size") / F.greatest("size", "centre.size")
    stars = members.join(centres, "key").where((F.col("node") != F.col("centre.node")) & (ratio >= similarity))
    pairs = saved(stars.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct())
    edges = alike(pairs, shingle_sets(docs, saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())), similarity)
    labels = saved(components(edges))

    placed = saved(members.join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label")))
    apart = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    rest = saved(placed.join(apart, "key", "left_semi").select("node", "size", "label").distinct())
    if not rest.isEmpty():
        sets = shingle_sets(docs, rest.select("node"))
        more = alike(prefix_pairs(rest, sets, similarity), sets, similarity)
        labels = saved(components(saved(edges.unionByName(more))))
    ids = prints.select("doc_id", "class").join(classes.select("class", "node"), "class").join(labels, "node", "left")
    return ids.groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("component_id"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark, sf_dir):
    """op2: fingerprint and component of each document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
