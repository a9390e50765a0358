"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm on islands.

Documents become token ids, are closed by an end id and cut into pieces of at most `capacity` ids. Full pieces are
sequences of their own. The rest are dealt by hash into districts of a bounded number of pieces; each district is evolved
by several islands, each with a population of packings of its own. An epoch runs every island in parallel; between epochs
each island's elite migrates to the next island of its district. A packing is a set of bins; crossover injects the
best-filled bins of one parent whole into the other, removes bins that now hold a piece twice, and puts the displaced
pieces back by best fit. Mutation dissolves the worst-filled bins. The first population is best fit by falling length
and by perturbed lengths, so no island does worse than best-fit decreasing.

Bins of the best packing that leave more than `slack` ids free are dissolved and dealt again, districts merged, until all
the loose pieces fit one district; so the whole corpus wastes about what one district does. State between epochs is
written to the checkpoint folder.

Null and empty texts give one piece of the end id alone. Every row is packed, repeated texts and ids too: a piece is
known by a number of its own. Extra columns of the input are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

CAPACITY = 2048
#: Pieces of a district, islands of a district, epochs, generations in an epoch, packings of an island.
DISTRICT, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2000, 3, 5, 8, 6
#: Characters that Python's split parts words at and the tokenizer does not.
NOT_BLANK = ("\x1c", "\x1d", "\x1e", "\x1f")


class TextIds:
    """Little-endian ids of texts.

    Where white space never reaches a token and the tokenizer's own first split is FIRST_SPLIT, which a set of probes
    shows when it is built, each distinct part of a text is encoded once and kept. In a Latin-1 text lower case and
    composition need no context, and the split is a plain pattern; other texts, and those with a special token, are
    encoded word by word by the tokenizer itself. For any other tokenizer whole texts are encoded.
    """

    #: The tokenizer's first split, as its file states it, with its letters and numbers among Latin-1 in lower case.
    LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
    FIRST_SPLIT = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}{NUMBERS}]+")
    END = "</w>"
    #: Texts whose ids the split must give: contractions, cases, digits, runs of signs and of white space, accents.
    PROBES = (
        "It's we'd THEY'LL 'Quoted' o'clock x'y 12345 a1b22c ...?! -- (a)[b]{c} e@f.gh\n\n\tend  of   line\r\n",
        "Ça déjà VU Übergröße ÄÖÜ ß ñandú ¿Qué? ¡Sí! 5¼ x² ªº µm «a» © ® £5 naïve ÿ Þorn ÷×",
        "snake_case camelCase UPPER_CASE http://x.yz/a?b=c&d=e%20f # $ % ^ & * ~ ` | \\ / < > = + ; :",
    )
    #: Parts and words that are kept; beyond, the memory starts anew with the next texts.
    MOST = 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.END)]] = True
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.by_parts = True
        self.by_parts = all(got == self.encode([t])[0].tobytes() == self.by_word(t) for t, got in zip(self.PROBES, self.of(list(self.PROBES)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: set[str]) -> None:
        """Encodes parts in one call: the last token of each part, and no other, carries the word-end mark."""
        new = list(parts)
        ids = self.encode([" ".join(new)])[0]
        stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, dtype=int)
        if len(stops) == len(new):
            raw, at = ids.tobytes(), [0, *(4 * stops).tolist()]
            self.parts.update({p: raw[i:j] for p, i, j in zip(new, at, at[1:], strict=False)})
        else:
            self.parts.update({p: x.tobytes() for p, x in zip(new, self.encode(new), strict=True)})

    def by_word(self, text: str) -> bytes:
        if any(c in text for c in NOT_BLANK):
            return self.encode([text])[0].tobytes()
        words = text.split()
        if new := [w for w in dict.fromkeys(words) if w not in self.words]:
            self.words.update({w: x.tobytes() for w, x in zip(new, self.encode(new), strict=True)})
        return b"".join(map(self.words.__getitem__, words))

    @staticmethod
    def plain(text: str) -> bool:
        if "<|" in text or any(c in text for c in NOT_BLANK):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def of(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if not self.by_parts:
            return [x.tobytes() for x in self.encode(texts)]
        found = [self.FIRST_SPLIT.findall(t.lower()) if self.plain(t) else None for t in texts]
        for kept in (self.parts, self.words):
            if len(kept) > self.MOST:
                kept.clear()
        if new := set(filterfalse(self.parts.__contains__, chain.from_iterable(f for f in found if f))):
            self.learn(new)
        part = self.parts.__getitem__
        return [self.by_word(t) if f is None else b"".join(map(part, f)) for t, f in zip(texts, found, strict=True)]


@lru_cache(maxsize=1)
def text_ids(path: str) -> TextIds:
    """One for each Python worker, whatever the number of its tasks."""
    return TextIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): ids are little-endian unsigned 32-bit numbers in one binary, null
    unless `with_ids`."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, end = text_ids(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts.of(part.column("text").to_pylist()), strict=True):
                    ids = text + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


Bins = list[list[int]]


def best_fit(lengths: list[int], order: list[int], bins: Bins, room: list[int], capacity: int) -> None:
    """Puts the pieces in this order into the bin with the least room that holds them; opens bins as needed.

    Bins are kept by room; the rooms in use are the bits of one integer, so the least sufficient one is its lowest bit
    from the length up.
    """
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        by_room.setdefault(r, []).append(b)
        mask |= 1 << r
    for i in order:
        n = lengths[i]
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
            room.append(capacity)
        room[b] = r - n
        by_room.setdefault(r - n, []).append(b)
        mask |= 1 << (r - n)


def fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones: the sum of squared fills."""
    return -len(room), sum(((capacity - r) / capacity) ** 2 for r in room)


def crossover(lengths: list[int], a: Bins, b: Bins, rng: np.random.Generator, capacity: int, share: float = 0.5) -> Bins:
    """Child of b with the best-filled bins of a injected whole."""
    room_a = [capacity - sum(lengths[i] for i in x) for x in a]
    ranked = sorted(range(len(a)), key=lambda k: room_a[k])
    chosen = [a[k] for k in ranked[: max(1, int(len(a) * share * rng.random()))]]
    taken = {i for x in chosen for i in x}
    kept = [x for x in b if taken.isdisjoint(x)]
    displaced = [i for x in b if not taken.isdisjoint(x) for i in x if i not in taken]
    return repack(lengths, [list(x) for x in chosen] + [list(x) for x in kept], displaced, rng, capacity)


def mutate(lengths: list[int], bins: Bins, rng: np.random.Generator, capacity: int) -> Bins:
    """Dissolves the worst-filled bins and a few at random."""
    room = [capacity - sum(lengths[i] for i in x) for x in bins]
    ranked = sorted(range(len(bins)), key=lambda k: -room[k])
    n = max(2, len(bins) // 50)
    out = {*ranked[:n], *rng.integers(0, len(bins), n).tolist()}
    return repack(lengths, [list(x) for k, x in enumerate(bins) if k not in out], [i for k in out for i in bins[k]], rng, capacity)


def repack(lengths: list[int], bins: Bins, displaced: list[int], rng: np.random.Generator, capacity: int) -> Bins:
    noise = rng.random(len(displaced)) * 16
    order = [displaced[k] for k in sorted(range(len(displaced)), key=lambda k: -lengths[displaced[k]] + noise[k])]
    room = [capacity - sum(lengths[i] for i in x) for x in bins]
    best_fit(lengths, order, bins, room, capacity)
    return bins


def first_population(lengths: list[int], rng: np.random.Generator, size: int, capacity: int) -> list[Bins]:
    out = []
    for k in range(size):
        scale = 1 + (rng.random(len(lengths)) - 0.5) * 0.1 * k
        bins: Bins = []
        best_fit(lengths, np.argsort(-np.asarray(lengths) * scale, kind="stable").tolist(), bins, [], capacity)
        out.append(bins)
    return out


def evolve(lengths: list[int], population: list[Bins], rng: np.random.Generator, generations: int, capacity: int) -> list[Bins]:
    """The population after so many generations, best first. Stops when the bins reach the bound by total length."""
    key = lambda bins: fitness([capacity - sum(lengths[i] for i in x) for x in bins], capacity)
    bound, size = -(-sum(lengths) // capacity), len(population)
    scored = sorted(((key(x), n, x) for n, x in enumerate(population)), reverse=True)
    for g in range(generations):
        if len(scored[0][2]) <= bound:
            break
        a, b = (scored[int(rng.integers(0, len(scored)))][2] for _ in range(2))
        children = [crossover(lengths, a, b, rng, capacity), mutate(lengths, scored[0][2], rng, capacity)]
        scored = sorted([*scored, *((key(x), size * (g + 1) + n, x) for n, x in enumerate(children))], reverse=True)[:size]
    return [x for _, _, x in scored]


def evolve_districts(pieces: DataFrame, districts: int, capacity: int, seed: int) -> DataFrame:
    """(key, length, bin): pieces with the bin that the best island of their district gave them."""
    state_schema = "district long, island int, n_bins int, bound int, state binary, elite binary"
    dealt = pieces.withColumn("district", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(districts)))

    def row(district: int, island: int, keys: np.ndarray, lengths: list[int], population: list[Bins]) -> tuple:
        state = pickle.dumps((keys, lengths, population[1:]))
        return district, island, len(population[0]), -(-sum(lengths) // capacity), state, pickle.dumps(population[0])

    def start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        keys, lengths = pdf["key"].to_numpy(), pdf["length"].tolist()
        out = []
        for island in range(ISLANDS):
            rng = np.random.default_rng([int(key[0]), island, seed])
            best = evolve(lengths, first_population(lengths, rng, POPULATION, capacity), rng, GENERATIONS, capacity)
            out.append(row(key[0], island, keys, lengths, best))
            if out[-1][2] <= out[-1][3]:  # no packing has fewer bins: the other islands have nothing to find
                break
        return pd.DataFrame(out, columns=state_schema.replace(",", "").split()[::2])

    def epoch(number: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            own, guest = pdf[pdf["migrant"] == 0].iloc[0], pdf[pdf["migrant"] == 1].iloc[0]
            keys, lengths, rest = pickle.loads(own["state"])
            population = [pickle.loads(own["elite"]), *rest[:-1], pickle.loads(guest["elite"])]
            best = evolve(lengths, population, np.random.default_rng([*map(int, key), number, seed]), GENERATIONS, capacity)
            return pd.DataFrame([row(*key, keys, lengths, best)], columns=state_schema.replace(",", "").split()[::2])

        return run

    todo = saved(dealt.groupBy("district").applyInPandas(start, state_schema))
    finished = []
    for number in range(1, EPOCHS):  # of districts whose islands all miss the bound by total length
        reached = todo.groupBy("district").agg((F.min("n_bins") <= F.max("bound")).alias("reached"))
        marked = todo.join(reached, "district")
        finished.append(marked.where("reached").drop("reached"))
        todo = marked.where("NOT reached").drop("reached")
        if todo.isEmpty():
            break
        guests = todo.select("district", ((F.col("island") + 1) % ISLANDS).alias("island"), "n_bins", "bound", F.lit(None).cast("binary").alias("state"), "elite", F.lit(1).alias("migrant"))
        todo = saved(todo.withColumn("migrant", F.lit(0)).unionByName(guests).groupBy("district", "island").applyInPandas(epoch(number), state_schema))
    islands = reduce(DataFrame.unionByName, finished, todo)

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for district, best in zip(pdf["district"], pdf["best"], strict=True):
                (keys, lengths, _), bins = pickle.loads(best["state"]), pickle.loads(best["elite"])
                rows = [(keys[i], lengths[i], district, b, capacity - sum(lengths[j] for j in x)) for b, x in enumerate(bins) for i in x]
                yield pd.DataFrame(rows, columns=["key", "length", "district", "bin", "room"])

    best = islands.groupBy("district").agg(F.min_by(F.struct("state", "elite"), F.struct("n_bins", "island")).alias("best"))
    return best.mapInPandas(unfold, "key long, length long, district long, bin long, room long")


def assign(pieces: DataFrame, capacity: int = CAPACITY, slack: int = 2) -> DataFrame:
    """(key, length, sequence_id) for pieces (key, length) with distinct keys from 0. A full piece has sequence_id -1 - key;
    others have their level, district and bin in its bits."""
    done = pieces.where(F.col("length") == capacity).select("key", "length", (-1 - F.col("key")).alias("sequence_id"))
    left, level = saved(pieces.where(F.col("length") < capacity).select("key", "length")), 0
    while n := left.count():
        districts = -(-n // DISTRICT)
        packed = saved(evolve_districts(left, districts, capacity, level))
        tight = F.col("room") <= (slack if districts > 1 else capacity)
        done = done.unionByName(packed.where(tight).select("key", "length", ((F.lit(level).cast("long") * (1 << 56)) + F.col("district") * (1 << 16) + F.col("bin")).alias("sequence_id")))
        left, level = packed.where(~tight).select("key", "length"), level + 1
        if level % 3 == 0:  # few tight bins are left to find: settle for more room
            slack = slack * 4 + 1
    return done


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, and others) with sequence_id and the offset of each in its sequence."""
    keyed = saved(pieces.withColumn("_key", F.monotonically_increasing_id()))
    placed = assign(keyed.select(F.col("_key").alias("key"), F.col("length")), capacity)
    # a sequence holds at most `capacity` pieces, so a window over it is bounded
    before = W.partitionBy("sequence_id").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return keyed.join(placed.select(F.col("key").alias("_key"), "sequence_id", "offset"), "_key").drop("_key")


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, n_pieces): the ids of each packed sequence as an array, ready to write for training."""
    packed = pack(token_pieces(docs, tokenizer, end_id, capacity), capacity)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.size("parts").alias("n_pieces"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    """op1: the pieces of all documents and their places."""
    pieces = token_pieces(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)
    return pack(pieces.drop("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
