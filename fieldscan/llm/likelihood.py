"""Log probability of texts by prediction by partial matching (PPM) over bytes, with escapes and symbol exclusion.

Model. A symbol is a byte of the text, A-Z lower-cased, or the end of the text; it is predicted from the ORDER bytes before it
(start marks where the text has fewer). The trie of contexts is held as tables, one for each order: a row is a context and a
symbol, as one number, with its count: in the longest contexts the occurrences in the learning texts, in shorter ones the longer
contexts that have the symbol (update exclusion). A context that was met gives a symbol met in it (n - d) / t, t being the sum
of its counts and d the DISCOUNT, and leaves q d / t, for its q symbols, to the next shorter context, in which the symbols of the
longer one are excluded; contexts that were not met pass. What no context has shares the rest evenly. The symbols of a context
are always among those of the shorter, so exclusion needs one subtraction: what the longer context's symbols count in the
shorter. Probabilities of a context sum to one.

Scale. The counts run over every learning text and are neither pruned nor sent to the driver. Texts are cut, between words,
into parts, and parts gathered into blocks of BLOCK bytes. A block asks once for each context and symbol in it; what is asked is
joined with the tables, order by order (a context has at most 257 symbols, so no key is hot), and the answers meet the block's
texts, so a task holds one block and its answers. Words for the base score go the same way.

Null texts are empty: one token, the end. Rows are scored one by one, also where ids repeat or are null; an empty table gives
none. With nothing to learn from, every symbol has 1 / 257. A text without white space is one part, however long.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_BATCH, held_out, release, saved, table

#: Bytes of context; bits of a symbol in a number (ORDER + 2 symbols must fit into 63 bits).
ORDER, BITS = 5, 9
#: What a symbol's count gives to the symbols its context lacks.
DISCOUNT = 0.3
#: Symbols beside the 256 bytes, and how many can be predicted.
END, START, SYMBOLS = 256, 257, 257
#: Bytes of a part and of a block, about; symbols that wait to be sorted, and words that wait to be summed or looked up; rows
#: sent at once.
PART, BLOCK, PENDING, PENDING_WORDS, SENT = 1 << 20, 3 << 23, 1 << 19, 1 << 16, 1 << 15
#: Tables in which a block's words are summed.
SHARDS = 16
BLANKS = np.frombuffer(b" \t\n\v\f\r", dtype=np.uint8)
#: The end of a text among the words, which are never empty.
END_WORD = b""

def cuts(text: bytes, part: int) -> list[int]:
    """Places that cut a text into parts of about `part` bytes, none inside a word."""
    out, data = [0], np.frombuffer(text, dtype=np.uint8)
    while len(text) - out[-1] > part:
        at, blank = out[-1] + part, np.zeros(0, dtype=np.int64)
        while not len(blank) and at < len(text):
            blank = np.flatnonzero(np.isin(data[at : at + part], BLANKS))
            at += int(blank[0]) if len(blank) else part
        if at >= len(text):
            break
        out.append(at)
    return [*out, len(text)]


@dataclass
class Part:
    """A part of a text: its row, whether it is learnt from, whether the text ends with it, and the bytes before and in it."""

    row: int
    learn: bool
    last: bool
    before: bytes
    text: bytes


def pack(parts: list[Part]) -> tuple[list[int], bytes]:
    """Numbers and compressed bytes of some parts."""
    numbers = [x for p in parts for x in (p.row, int(p.learn), int(p.last), len(p.before), len(p.text))]
    return numbers, pa.compress(b"".join(x for p in parts for x in (p.before, p.text)), codec="zstd", asbytes=True)


def unpacked(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, Part]]:
    """Block and part, one by one, of rows (block, numbers, bytes)."""
    for block, numbers, data in zip(*(batch.column(c).to_pylist() for c in ("block", "numbers", "bytes")), strict=True):
        numbers, at = np.array(numbers, dtype=np.int64).reshape(-1, 5), 0
        data = pa.decompress(data, decompressed_size=int(numbers[:, 3:].sum()), codec="zstd", asbytes=True)
        for row, learn, last, lead, size in numbers.tolist():
            yield block, Part(row, bool(learn), bool(last), data[at : at + lead], data[at + lead : at + lead + size])
            at += lead + size


def text_packs(docs: DataFrame, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(block, numbers, bytes, own, rows) of docs (own, learn, text): packs of parts, about `part` bytes each, in the order of the
    texts and of the blocks; rows and own have the number and the `own` of the texts that end in the pack."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = number = TaskContext.get().partitionId() << 32
        held = 0

        def send(parts: list[Part], own: pa.Array, ended: list[int]) -> pa.RecordBatch:
            numbers, data = pack(parts)
            taken = own.take(pa.array(ended, pa.int64()))
            arrays = [pa.array([number]), pa.array([numbers], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ended)], pa.int32()), taken), pa.array([[p.row for p in parts if p.last]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "numbers", "bytes", "own", "rows"])

        for batch in batches:
            texts, learn, own = batch.column("text").cast(pa.binary()), batch.column("learn"), batch.column("own")
            parts, ended, size = [], [], 0
            for k in range(batch.num_rows):
                text = (texts[k].as_py() or b"").lower()
                at = cuts(text, part)
                for i, j in zip(at, at[1:], strict=False):
                    parts.append(Part(row, learn[k].as_py(), j == len(text), text[max(0, i - ORDER) : i], text[i:j]))
                    ended += [k] * parts[-1].last
                    size, held = size + j - i + 1, held + j - i + 1
                    if size >= part or held >= block:
                        yield send(parts, own, ended)
                        parts, ended, size = [], [], 0
                    if held >= block:
                        number, held = number + 1, 0
                row += 1
            if parts:
                yield send(parts, own, ended)
        release()

    schema = T.StructType.fromDDL("block long, numbers array<long>, bytes binary").add("own", T.ArrayType(docs.schema["own"].dataType)).add("rows", T.ArrayType(T.LongType()))
    return docs.select("own", "learn", "text").mapInArrow(split, schema)


def coded(before: bytes, text: bytes, last: bool) -> np.ndarray:
    """A number for each symbol of text (and the end, in its last part) behind its ORDER symbols of context."""
    n = len(text) + last
    symbols = np.full(ORDER + n, START, dtype=np.int64)
    symbols[ORDER - len(before) : ORDER] = np.frombuffer(before, dtype=np.uint8)
    symbols[ORDER : ORDER + len(text)] = np.frombuffer(text, dtype=np.uint8)
    if last:
        symbols[-1] = END
    out = np.zeros(n, dtype=np.int64)
    for k in range(ORDER + 1):
        out <<= BITS
        out |= symbols[k : k + n]
    return out


def pieces(before: bytes, text: bytes, last: bool) -> Iterator[np.ndarray]:
    """coded(), at most PENDING at a time."""
    for at in range(0, max(1, len(text)), PENDING):
        yield coded(text[at - ORDER : at] if at else before, text[at : at + PENDING], last and at + PENDING >= len(text))


def runs(rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs."""
    first = np.flatnonzero(np.append(True, rising[1:] != rising[:-1])) if len(rising) else np.zeros(0, dtype=np.int64)
    return rising[first], np.diff(np.append(first, len(rising)))


def part_words(text: bytes, last: bool) -> list[bytes]:
    return [*text.split(), END_WORD] if last else text.split()


class WordCounts:
    """Distinct words with their counts, in columns, which take a fraction of the memory of objects; in SHARDS tables by a hash, as
    summing a table takes several times its memory."""

    def __init__(self):
        self.summed = [pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})] * SHARDS
        self.pending: dict[bytes, int] = {}

    def add(self, word: bytes, n: int) -> None:
        self.pending[word] = self.pending.get(word, 0) + n
        if len(self.pending) >= PENDING_WORDS:
            self.sum()

    def sum(self) -> pa.Table:
        shards: list[dict[bytes, int]] = [{} for _ in range(SHARDS)]
        for word, n in self.pending.items():
            shards[hash(word) % SHARDS][word] = n
        self.pending = {}
        for i, shard in enumerate(shards):
            if shard:
                more = pa.table({"word": pa.array(list(shard), pa.binary()), "n": pa.array(list(shard.values()), pa.int64())})
                sums = pa.concat_tables([self.summed[i], more]).group_by("word", use_threads=False).aggregate([("n", "sum")])
                self.summed[i] = pa.table({"word": sums.column("word"), "n": sums.column("n_sum")})
                del more, sums
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(self.summed)


class Asked:
    """Contexts with symbols, and words, of a block, with their counts in learning texts."""

    def __init__(self):
        self.codes = self.counts = np.zeros(0, dtype=np.int64)
        self.pending: list[tuple[np.ndarray, bool]] = []
        self.size = 0
        self.words = WordCounts()

    def add(self, part: Part) -> None:
        for word, n in Counter(part_words(part.text, part.last)).items():
            self.words.add(word, n * part.learn)
        for codes in pieces(part.before, part.text, part.last):
            self.pending.append((codes, part.learn))
            self.size += len(codes)
            if self.size >= PENDING:
                self.sort()

    def sort(self) -> None:
        codes, counts = [self.codes], [self.counts]
        for learn in (True, False):
            found = [c for c, flag in self.pending if flag == learn]
            if found:
                distinct, n = runs(np.sort(np.concatenate(found)))
                codes.append(distinct)
                counts.append(n * learn)
        codes, counts = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else codes
        self.codes, self.counts = codes[first], np.add.reduceat(counts, first) if len(codes) else counts
        self.pending, self.size = [], 0

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        self.sort()
        for at in range(0, len(self.codes), SENT):
            code, n = self.codes[at : at + SENT], self.counts[at : at + SENT]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block)), pa.array(code), pa.nulls(len(code), pa.binary()), pa.array(n)], names=["block", "code", "word", "n"])
        for some in self.words.sum().to_batches(SENT):
            n = some.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int64()), some.column("word"), some.column("n")], names=["block", "code", "word", "n"])


def asked(packs: DataFrame) -> DataFrame:
    """(block, code or word, n): what each block asks for, with counts in its learning texts. Tasks send each block's part of
    theirs, so a block may ask twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, Asked()
        for batch in batches:
            for block, part in unpacked(batch):
                if block != current:
                    if current is not None:
                        yield from held.batches(current)
                    current, held = block, Asked()
                held.add(part)
        if current is not None:
            yield from held.batches(current)
        release()

    return packs.select("block", "numbers", "bytes").mapInArrow(count, "block long, code long, word binary, n long")


class Answers:
    """Sums of the logarithms of each text's symbols. What is asked is sorted with the text's number behind the code, so that
    the logarithms are read in order and once for each code."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        order = np.argsort(codes, kind="stable")
        self.codes, self.logs = codes[order], logs[order]
        self.total: dict[int, float] = {}
        self.rows: list[int] = []
        self.pending: list[np.ndarray] = []
        self.size = 0

    def ask(self, row: int, codes: np.ndarray) -> None:
        self.pending.append((codes << BITS) | len(self.rows))
        self.rows.append(row)
        self.size += len(codes)
        if self.size >= PENDING or len(self.rows) == 1 << BITS:
            self.send()

    def send(self) -> None:
        if self.rows:
            keys = np.sort(np.concatenate(self.pending))
            codes, n = runs(keys >> BITS)
            logs = np.repeat(self.logs[np.searchsorted(self.codes, codes)], n)
            sums = np.bincount(keys & ((1 << BITS) - 1), weights=logs, minlength=len(self.rows))
            for row, x in zip(self.rows, sums.tolist(), strict=True):
                self.total[row] = self.total.get(row, 0.0) + x
        self.rows, self.pending, self.size = [], [], 0

    def sums(self, n: int) -> list[float]:
        self.send()
        return [self.total[k] for k in range(n)]


class Tokens:
    """Tokens, known tokens and base scores of texts: their words are looked up, many at once, among a block's words, whose
    counts add to `total` with one for each and for an unknown one."""

    def __init__(self, words: pa.Array, counts: np.ndarray, total: int):
        self.words, self.known = words, counts > 0
        values, at = np.unique(counts, return_inverse=True)
        self.logs = np.array([math.log10((c + 1) / total) for c in values.tolist()])[at]
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.asked: list[bytes] = []
        self.times: list[int] = []
        self.sizes: list[int] = []

    def ask(self, words: dict[bytes, int]) -> None:
        self.asked += words
        self.times += words.values()
        self.sizes.append(len(words))
        if len(self.asked) >= PENDING_WORDS:
            self.send()

    def send(self) -> None:
        at = pa.compute.index_in(pa.array(self.asked, self.words.type), value_set=self.words).to_numpy()
        text, times = np.repeat(np.arange(len(self.sizes)), self.sizes), np.array(self.times, dtype=np.int64)
        self.found.append(tuple(np.bincount(text, weights=w, minlength=len(self.sizes)) for w in (times, times * self.known[at], times * self.logs[at])))
        self.asked, self.times, self.sizes = [], [], []

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts in the order they came."""
        self.send()
        n, known, base = (np.concatenate(x) for x in zip(*self.found, strict=True))
        return n.astype(np.int64), known.astype(np.int64), base


def shares(n: Column, t: Column, q: Column, full: Column) -> tuple[Column, Column]:
    """The share of a symbol that counts n of the t counts of q symbols, and the share of those the context has not; a context
    that is full has every symbol and gives none away."""
    return F.when(full, n / t).otherwise((n - DISCOUNT) / t), F.when(full, 0.0).otherwise(q * DISCOUNT / t)


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, p) of grams (code, n): distinct contexts of `order` symbols with the symbol behind them, and its count there."""
    levels = [grams]
    for o in range(order - 1, -1, -1):
        short = F.col("code").bitwiseAND(F.lit((1 << (BITS * (o + 1))) - 1))
        levels.insert(0, saved(levels[0].groupBy(short.alias("code")).agg(F.count_if(F.col("n") > 0).alias("n"))))
    n, t, q = F.col("n"), F.col("t"), F.col("q")
    w = W.partitionBy(F.shiftright("code", BITS))
    found = None
    for o, level in enumerate(levels):
        if o:
            suffix = F.col("code").bitwiseAND(F.lit((1 << (BITS * o)) - 1))
            shorter = found.select(F.col("code").alias("suffix"), *(F.col(c).alias(f"{c}_") for c in ("n", "t", "q", "p", "low")))
            level = level.withColumn("suffix", suffix).join(shorter, "suffix")
        here = level.withColumn("t", F.sum("n").over(w)).withColumn("q", F.count_if(n > 0).over(w))
        if o:
            here = here.withColumn("own", F.sum(F.when(n > 0, F.col("n_")).otherwise(0)).over(w))
            left_t, left_q = F.col("t_") - F.col("own"), F.col("q_") - q
            met, unmet = shares(F.col("n_"), left_t, left_q, F.col("q_") >= SYMBOLS)
            low = F.when(F.col("n_") > 0, met).otherwise(F.when(left_q > 0, unmet).otherwise(1.0) * F.col("low_"))
            none = F.col("p_")
        else:
            low, none = 1.0 / F.greatest(SYMBOLS - q, F.lit(1)), F.lit(1.0 / SYMBOLS)
        here = here.withColumn("low", F.when(n == 0, low))
        met, unmet = shares(n, t, q, q >= SYMBOLS)
        p = F.when(t == 0, none).when(n > 0, met).otherwise(unmet * F.col("low"))
        found = saved(here.withColumn("p", p).select("code", "n", "t", "q", "p", "low"))
    return found.select("code", "p")


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """docs, with columns of its own and `text`, plus n_tokens, n_known, train_tokens, base_score and score.

    learn is a boolean column: the rows whose counts make the models. base_score is the log10 probability by token counts with
    one added, score that of the lower-cased text's bytes and its end by the model.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    packs = saved(text_packs(docs.select(F.struct(*rest).alias("own"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))), batch=TEXT_BATCH)
    asks = saved(asked(packs), "zstd", batch=TEXT_BATCH)
    codes, words = asks.where("code IS NOT NULL").select("block", "code", "n"), asks.where("word IS NOT NULL").select("block", "word", "n")
    # a word has a row for each block at most, so this window has no hot key
    w = W.partitionBy("word")
    first = F.row_number().over(w.orderBy("block")) == 1
    counted = saved(words.select("block", "word", "n", F.sum("n").over(w).alias("c"), first.alias("first")), "zstd")
    totals = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("distinct"))
    whole, distinct = totals.first()
    grams = saved(codes.groupBy("code").agg(F.sum("n").alias("n")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    # a logarithm's error of 1e-7 of itself leaves sums of many right to more digits than that
    answers = codes.drop("n").join(probabilities(grams), "code").select("block", "code", none("binary", "word"), F.log10("p").cast("float").alias("value"), none("long", "c"))
    answers = answers.unionByName(counted.select("block", none("long", "code"), "word", none("float", "value"), "c"))

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        is_code = found.column("code").is_valid()
        logs, counts = found.filter(is_code), found.filter(pa.compute.invert(is_code))
        answers = Answers(logs.column("code").to_numpy(), logs.column("value").to_numpy().astype(float))
        tokens = Tokens(counts.column("word").combine_chunks(), counts.column("c").to_numpy(), whole + distinct + 1)
        del logs, counts
        rows = []
        for k, (_, part) in enumerate(unpacked(texts)):
            for piece in pieces(part.before, part.text, part.last):
                answers.ask(k, piece)
            tokens.ask(Counter(part_words(part.text, part.last)))
            rows.append(part.row)
        sums, (n, known, base) = answers.sums(len(rows)), tokens.sums()
        del answers, tokens
        release()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip((rows, n, known, base, sums), kinds, strict=True)], names=["row", "n_tokens", "n_known", "base_score", "score"])

    texts = packs.select("block", "numbers", "bytes")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "row long, n_tokens long, n_known long, base_score double, score double")
    sums = scored.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    own = packs.select(F.explode(F.arrays_zip("rows", "own")).alias("e")).select("e.own", F.col("e.rows").alias("row"))
    return own.join(sums, "row").select("own.*", "n_tokens", "n_known", F.lit(whole).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir):
    """op13: log10 probability of every document, learned from rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"), 7, 2)
    return score_texts(docs.select("doc_id", fold.alias("held_out"), "text"), ~F.col("held_out"))
