"""The trie of the beginnings of conversations, with totals of its subtrees, by van Emde Boas recursion.

A node is a distinct sequence of first turns, named by its depth and the smallest id of a conversation that starts with it.

Down. Depths are cut at halves. A piece of a trie is the part below one node, its context, down to some depth; what runs through
the piece is cut at its half depth. All that share context and turns down to the cut get one name, the smallest id; one of them
goes on into the upper trie, for all, and each of them into the forest below the cut, with the name as context. Upper and lower
pieces are cut in the same round, so a trie of depth D is built in log2 D rounds, and a conversation is in one piece a round,
not in one for each turn. Turns are compared by digests of dyadic runs, made beforehand by doubling. In the last round each
piece is one turn high: names and contexts are then nodes and their parents.

Up. Totals are grafted in the opposite order: what the forest below a cut sums to is added to the cut node and to its ancestors
within the upper piece, pieces of double height a round. Tokens saved need no second pass: over a subtree, the sum of
(members - 1) x words is that of the members' words from its top on, less that of the nodes' words.

Rows are turns throughout, so neither a conversation nor a group of equal ones has to fit into a task; sums and minima are
partial before each shuffle. The digest of the members that end at a node reads their ids in order, packed, from a sort.

A conversation's turns are ordered by turn (null first), role, text; null roles and texts are empty. Rows with a null conv_id are
left out. Repeated rows are turns of their own. A table without conversations gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

WORD = r"[^\x20\x09-\x0D]+"
NODE = ("depth", "name")
SUMS = ("n", "leaves", "spoken", "words")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn_key, words): each turn's place from 0, a digest of its role and text, and its words.

    Turns are dealt by range and counted within each share; the counts before it place a share, so that a conversation may be
    any part of the table."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "text")
    key = F.unhex(F.sha2(F.concat_ws("\0", F.octet_length("role").cast("string"), "role", "text").cast("binary"), 256))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().alias("share"), F.monotonically_increasing_id().alias("place"), key.alias("turn_key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    dealt = saved(dealt)
    first = dealt.groupBy("conv_id", "share").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("share").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = first.select("conv_id", "share", (before - F.col("first")).alias("shift"))
    return dealt.join(first, ["conv_id", "share"]).select("conv_id", (F.col("place") + F.col("shift")).alias("at"), "turn_key", "words")


def doubled(turns: DataFrame, rounds: int) -> list[DataFrame]:
    """Tables (conv_id, at, run_key, words) of the runs of 1, 2, 4, ... turns that begin at a multiple of their length."""
    levels = [saved(turns.select("conv_id", "at", F.col("turn_key").alias("run_key"), "words"))]
    for k in range(1, rounds):
        half = 1 << (k - 1)
        second = F.col("at").bitwiseAND(half) > 0
        pair = levels[-1].groupBy("conv_id", (F.col("at") - F.col("at").bitwiseAND(half)).alias("at"))
        keys = pair.agg(F.max(F.when(~second, F.col("run_key"))).alias("a"), F.max(F.when(second, F.col("run_key"))).alias("b"), F.sum("words").alias("words"))
        levels.append(saved(keys.where("a IS NOT NULL AND b IS NOT NULL").select("conv_id", "at", F.unhex(F.sha2(F.concat("a", "b"), 256)).alias("run_key"), "words")))
    return levels


def built(lengths: DataFrame, turns: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (depth, name, parent, before, words), but for the root, and ends (conv_id, depth, name).

    lengths has (conv_id, turns), turns what numbered_turns gives; no conversation has more than 2^rounds turns. before is the
    number of words above a node.
    """
    runs = doubled(turns, rounds)
    # what runs through a piece: from depth `low`, below the node (low, context), to depth `end`; whole: it ends there
    pieces = lengths.where("turns > 0").select(F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("context"), "conv_id", F.col("turns").alias("end"), F.lit(True).alias("whole"), F.lit(0).cast("long").alias("before"))
    place = lambda df: df.select("conv_id", F.col("at").alias("low"), "run_key", "words")
    key = ["low", "upper", "run_key"]
    for k in range(rounds - 1, -1, -1):
        cut = F.col("low") + (1 << k)
        crossing = pieces.where(F.col("end") >= cut).join(place(runs[k]), ["conv_id", "low"]).withColumn("upper", F.coalesce("context", F.lit(0)))
        crossing = saved(crossing)
        names = saved(crossing.groupBy(*key).agg(F.min("conv_id").alias("name"), F.first("context").alias("context"), F.first("before").alias("before")))
        upper = names.select("low", "context", F.col("name").alias("conv_id"), cut.alias("end"), F.lit(False).alias("whole"), "before")
        short = pieces.where(F.col("end") <= cut)
        below = crossing.where(F.col("end") > cut).join(names.select(*key, "name"), key)
        below = below.select(cut.alias("low"), F.col("name").alias("context"), "conv_id", "end", "whole", (F.col("before") + F.col("words")).alias("before"))
        pieces = saved(short.unionByName(upper).unionByName(below))
    last = saved(pieces.join(place(runs[0]), ["conv_id", "low"]).withColumn("upper", F.coalesce("context", F.lit(0))))
    names = saved(last.groupBy(*key).agg(F.min("conv_id").alias("name"), F.first("context").alias("parent"), F.first("before").alias("before"), F.first("words").alias("words")))
    nodes = names.select((F.col("low") + 1).alias("depth"), "name", "parent", "before", "words")
    ends = last.where("whole").join(names.select(*key, "name"), key).select("conv_id", (F.col("low") + 1).alias("depth"), "name")
    return saved(nodes), saved(ends)


def grafted(nodes: DataFrame, rounds: int) -> DataFrame:
    """(depth, name, and SUMS over the subtree) of nodes (depth, name, parent, and SUMS of their own)."""
    sums = [F.sum(c).alias(c) for c in SUMS]
    total = nodes
    up = nodes.select("depth", "name", F.col("depth").alias("over"), F.col("name").alias("over_name"), F.col("parent").alias("above"))
    for k in range(rounds):
        # up: nodes at multiples of 2^k with their ancestors within 2^k turns, themselves included
        size, depth = 1 << k, F.col("depth")
        cut = depth % (2 * size) == size
        forests = total.where((depth - 1) % (2 * size) == size).groupBy((depth - 1).alias("depth"), F.col("parent").alias("name")).agg(*sums)
        gained = up.where(cut).join(forests, ["depth", "name"]).groupBy(F.col("over").alias("depth"), F.col("over_name").alias("name")).agg(*sums)
        total = saved(total.unionByName(gained, allowMissingColumns=True).groupBy(*NODE).agg(F.max("parent").alias("parent"), *sums))
        if k + 1 < rounds:
            whole = up.where(depth % (2 * size) == 0)
            top = whole.where(F.col("over") == depth - size + 1).select("depth", "name", F.col("above").alias("cut_name"))
            more = up.where(cut).select((depth + size).alias("depth"), F.col("name").alias("cut_name"), "over", "over_name", "above")
            up = saved(whole.unionByName(top.join(more, ["depth", "cut_name"]).drop("cut_name")))
    return total.drop("parent")


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256) of ends (conv_id, depth, name): the digest of the decimal ids, rising and comma-joined.

    Ids are sorted and packed where they are; a node's packs are then read one after the other, so that even a node with most of
    the ids holds no more than a pack at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, name, ids = (batch.column(c).to_pylist() for c in ("depth", "name", "conv_id"))
            edges = [0, *(k for k in range(1, len(ids)) if (depth[k], name[k]) != (depth[k - 1], name[k - 1])), len(ids)]
            spans = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]
            columns = ([depth[a] for a, _ in spans], [name[a] for a, _ in spans], [ids[a] for a, _ in spans])
            texts = pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), texts], names=["depth", "name", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([current[0]]), pa.array([current[1]]), pa.array([held.hexdigest()])], names=["depth", "name", "ends_sha256"])
        for batch in batches:
            done = []
            for depth, name, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "ids")), strict=True):
                if (depth, name) != current:
                    if current is not None:
                        done.append(row())
                    current, held = (depth, name), hashlib.sha256(ids.encode())
                else:
                    held.update(b"," + ids.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if current is not None:
            yield row()

    order = ("depth", "name", "conv_id")
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "depth long, name long, first long, ids string")
    packed = packed.repartition("depth", "name").sortWithinPartitions("depth", "name", "first")
    return packed.mapInArrow(digest, "depth long, name long, ends_sha256 string")


def prefix_trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of
    conversations: lengths (conv_id, turns) names them all, turns (conv_id, at, turn_key, words) has their turns from place 0."""
    lengths = saved(lengths)
    longest = lengths.agg(F.max("turns")).first()[0]
    if longest is None:
        return lengths.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    rounds = max(1, int(longest - 1).bit_length()) if longest else 1
    nodes, ends = built(lengths, turns, rounds)
    top = F.lit(lengths.agg(F.min("conv_id")).first()[0]).cast("long")
    zero, no_id = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = lengths.sparkSession.range(1).select(zero.alias("depth"), top.alias("name"), no_id.alias("parent"), zero.alias("before"), zero.alias("words"))
    at_root = lengths.where("turns = 0").select("conv_id", zero.alias("depth"), top.alias("name"))
    nodes = saved(nodes.withColumn("parent", F.when(F.col("depth") == 1, top).otherwise(F.col("parent"))).unionByName(root))
    ends = ends.unionByName(at_root)

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    here = ends.groupBy(*NODE).agg(F.count("*").alias("n"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nodes = saved(nodes.join(children, list(NODE), "left").join(here, list(NODE), "left").select(*NODE, "parent", "before", "words", none("n_children"), none("n")))
    # spoken: words that the members which end here say in all
    own = nodes.select(*NODE, "parent", "n", (F.col("n_children") == 0).cast("long").alias("leaves"), (F.col("n") * (F.col("before") + F.col("words"))).alias("spoken"), "words")
    below = grafted(own.where("depth > 0"), rounds)
    whole = own.where("depth = 0").drop("parent").unionByName(below.where("depth = 1").select(zero.alias("depth"), top.alias("name"), *SUMS))
    sums = below.unionByName(whole.groupBy(*NODE).agg(*(F.sum(c).alias(c) for c in SUMS))).select(*NODE, F.col("n").alias("n_convs"), F.col("leaves").alias("n_leaves"), "spoken", F.col("words").alias("node_words"))
    out = nodes.join(sums, list(NODE)).join(id_digests(ends), list(NODE), "left")
    saving = F.col("spoken") - F.col("before") * F.col("n_convs") - F.col("node_words")
    return out.select(F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saving.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def trie_of(conversations: DataFrame) -> DataFrame:
    """prefix_trie of conversations (conv_id, turn, role, text) as they are."""
    turns = saved(numbered_turns(conversations))
    return prefix_trie(turns.groupBy("conv_id").agg(F.count("*").alias("turns")), turns)


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turns) and (conv_id, at, turn_key, words) of conversations whose first turns, up to head_length of them, are
    those of the conversation at the multiple of 20 at or below their id; their own turns follow after as many of their first."""
    convs = turns.select("conv_id").distinct().withColumn("h", head_length(F.col("conv_id")))
    base = turns.where("at < 3").withColumnRenamed("conv_id", "base")
    heads = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(base, "base").where("at < h").select("conv_id", "at", "turn_key", "words")
    heads = saved(heads)
    size = saved(convs.join(heads.groupBy("conv_id").agg(F.count("*").alias("have")), "conv_id", "left").select("conv_id", "h", F.coalesce("have", F.lit(0)).alias("have")))
    own = turns.where(F.col("at") >= head_length(F.col("conv_id"))).join(size, "conv_id").select("conv_id", (F.col("at") - F.col("h") + F.col("have")).alias("at"), "turn_key", "words")
    own = saved(own)
    lengths = size.join(own.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "left").select("conv_id", (F.col("have") + F.coalesce("n", F.lit(0))).alias("turns"))
    return lengths, heads.unionByName(own)


def query(spark, sf_dir):
    """op12: every node of the trie of the rebuilt conversations."""
    return prefix_trie(*with_shared_heads(saved(numbered_turns(table(spark, sf_dir, "conversations")))))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, t.pos, k, w FROM c JOIN t ON t.conv_id = c.base WHERE t.pos < h
  UNION ALL SELECT c.conv_id, 1, t.pos, k, w FROM c JOIN t USING (conv_id) WHERE t.pos >= h),
l AS (SELECT c.conv_id, coalesce(list(k ORDER BY part, pos) FILTER (WHERE k IS NOT NULL), []) AS ks, coalesce(list(w ORDER BY part, pos) FILTER (WHERE k IS NOT NULL), []) AS ws FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
p AS (SELECT conv_id, d AS depth, len(ks) AS n, array_to_string(ks[1 : d], ',') AS key, array_to_string(ks[1 : d - 1], ',') AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM l, unnest(generate_series(0, len(ks))) AS g(d)),
node AS (
  SELECT depth, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM p GROUP BY depth, key),
kids AS (SELECT a.depth, a.key, count(b.key) AS n_children FROM node a LEFT JOIN node b ON b.depth = a.depth + 1 AND b.up = a.key GROUP BY ALL),
under AS (
  SELECT p.depth, p.key, CAST(sum((n_children = 0)::INT) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * node.w) AS BIGINT) AS saved_tokens
  FROM node JOIN kids USING (depth, key) JOIN p ON p.conv_id = node.conv_id AND p.depth <= node.depth GROUP BY ALL)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN kids USING (depth, key) JOIN under USING (depth, key) LEFT JOIN node up ON up.depth = node.depth - 1 AND up.key = node.up
"""
