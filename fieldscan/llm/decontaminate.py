"""Benchmark decontamination: a prefix-filtered set join between benchmark windows and document words.

All of it is DataFrame operations. A window is a run of `size` words of an item (all words of a shorter item). Because a
window must be contained whole, the necessary prefix of its words, ordered by rarity over all documents, is its rarest
word: a document without that word cannot hold the window. Each place of such a word in a document is a candidate with
the words around it; the join is on the word, bounds on the position drop candidates that would start before the
document or end after it, and the words are then compared one by one.

Null and empty texts have no words, no hits and no items. Documents are judged row by row, also those that repeat an id or
have none; repeated items count by item_id. Items without words match nothing. flag_contaminated keeps other columns and
replaces `_n_hit` and `_items`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fold_ascii, saved, table

#: ASCII characters that part words, once A-Z are folded.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table goes to every task up to so many bytes of text and BROADCAST_ROWS rows; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 32_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(fold_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct (item_id, window) with windows as arrays of words."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("window")).distinct()


def held(df: DataFrame, text: Column) -> DataFrame:
    """df with a broadcast hint when its counted rows and bytes of text are within the limits."""
    n, n_bytes = df.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (n_bytes or 0) <= BROADCAST_BYTES else df


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, count) over all documents for the words of the vocabulary."""
    words = docs.select(F.explode(words_of(F.col("text"))).alias("word"))
    return words.join(held(vocabulary, F.col("word")), "word", "left_semi").groupBy("word").count()


def prefixes(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, window, key, offset, length): each distinct window with its rarest word and that word's first place.

    Rarity is the number of occurrences over all documents, ties by the word itself; words that no document has are the
    rarest, so their windows leave the join at once.
    """
    windows = item_windows(benchmark, size).withColumn("length", F.size("window"))
    vocabulary = saved(windows.select(F.explode("window").alias("word")).distinct())
    counts = saved(word_counts(docs, vocabulary))
    ranked = windows.select("item_id", "window", "length", F.posexplode("window").alias("offset", "word")).join(held(counts, F.col("word")), "word", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "offset")).alias("first")
    return ranked.groupBy("item_id", "window", "length").agg(rarest).where("first.count > 0").select("item_id", "window", "length", F.col("first.word").alias("key"), F.col("first.offset").alias("offset"))


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, part, item_id, start, length): each occurrence of an item's window, start counted in words from 0; part, a
    hash of the text, tells apart rows of one id."""
    keyed = saved(prefixes(docs, benchmark, size))
    keys = held(saved(keyed.select("key").distinct()), F.col("key"))
    words = docs.select("doc_id", F.xxhash64("text").alias("part"), words_of(F.col("text")).alias("words"))
    places = words.select("*", F.posexplode("words").alias("pos", "key")).join(keys, "key", "left_semi")
    first = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    found = places.select("doc_id", "part", "pos", "key", (F.col("pos") - first).alias("before"), F.slice("words", first + 1, F.col("pos") - first + size).alias("near"))
    joined = found.join(held(keyed, F.array_join("window", " ")), "key")
    begins = F.col("before") - F.col("offset")
    bounded = joined.where((begins >= 0) & (begins + F.col("length") <= F.size("near")))
    same = bounded.where(F.slice("near", begins + 1, F.col("length")) == F.col("window"))
    return same.select("doc_id", "part", "item_id", (F.col("pos") - F.col("offset")).cast("long").alias("start"), F.col("length").cast("long").alias("length"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, part, n_hit, items) for documents with a hit: words inside any occurrence, and the sorted ids of the items.

    Hits of a word are made distinct per document and place before they are counted, so a passage that many items share,
    or a document that repeats one, adds partial sums and no large group.
    """
    hits = saved(occurrences(docs, benchmark, size).distinct())
    covered = hits.select("doc_id", "part", "start", "length").distinct().select("doc_id", "part", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("word")).distinct()
    n_hit = covered.groupBy("doc_id", "part").agg(F.count("*").alias("n_hit"))
    items = hits.select("doc_id", "part", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id", "part").agg(F.sort_array(F.collect_list("item")).alias("items"))
    same = n_hit["doc_id"].eqNullSafe(items["doc_id"]) & (n_hit["part"] == items["part"])
    return n_hit.join(items, same).select(n_hit["doc_id"], n_hit["part"], "n_hit", "items")


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs with `_n_hit` (0 where none) and `_items` (empty where none)."""
    rest = docs.drop("_n_hit", "_items")
    found = saved(contamination(docs, benchmark, size).select(F.col("doc_id").alias("hit_id"), F.col("part").alias("hit_part"), "n_hit", "items"))
    found = held(found, F.array_join("items", ","))
    same = rest["doc_id"].eqNullSafe(found["hit_id"]) & (F.xxhash64(rest["text"]) == found["hit_part"])
    n_hit = F.coalesce(found["n_hit"], F.lit(0).cast("long")).alias("_n_hit")
    items = F.coalesce(found["items"], F.array().cast("array<string>")).alias("_items")
    return rest.join(found, same, "left").select(*(rest[c] for c in rest.columns), n_hit, items)


def query(spark, sf_dir):
    """op9: contaminated words and items per document."""
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    flagged = flag_contaminated(docs, benchmark)
    return flagged.select(
        "doc_id",
        F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS win
  FROM b, unnest(generate_series(0, greatest(len(w) - 10, 0))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM d, sizes, unnest(generate_series(0, len(w) - n)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(generate_series(0, n - 1)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
