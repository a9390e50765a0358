"""Corpus audits, prefix tries and model scores against plain versions, with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing names."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldscan.llm import divergence, likelihood, prefixes

LONG = " ".join(f"w{i % 977}" for i in range(40_000))
TEXTS = [None, "", "   \n\t", "one", "one", "A b C d e", "token = abcdefghij0123456789", LONG, LONG, "é ü ß 日本", "x" * 5000, "abracadabra abra", "the cat sat on the mat, the cat"]


def awkward(spark, texts=TEXTS):
    rows = [(i, t, None, None, None, "clash", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, learn string, score double")


# scores


def symbols(text):
    return [likelihood.START] * likelihood.ORDER + list((text or "").encode().lower()) + [likelihood.END]


class PlainModel:
    """Prediction by partial matching, symbol by symbol."""

    def __init__(self, texts):
        pairs = Counter()
        for s in map(symbols, texts):
            pairs.update((tuple(s[i : i + likelihood.ORDER]), s[i + likelihood.ORDER]) for i in range(len(s) - likelihood.ORDER))
        self.levels = []
        for _ in range(likelihood.ORDER + 1):
            level = defaultdict(dict)
            for (c, s), n in pairs.items():
                level[c][s] = n
            self.levels.append(level)
            pairs = Counter((c[1:], s) for c, s in pairs)

    def p(self, context, symbol, d=likelihood.DISCOUNT):
        p, excluded = 1.0, set()
        for k, level in enumerate(self.levels):
            have = level.get(context[k:], {})
            left = {s: n for s, n in have.items() if s not in excluded}
            if left:
                t, full = sum(left.values()), len(have) == likelihood.SYMBOLS
                if symbol in left:
                    return p * (left[symbol] - d * (not full)) / t
                p *= 0 if full else d * len(left) / t
                excluded |= set(have)
        return p / (likelihood.SYMBOLS - len(excluded)) if len(excluded) < likelihood.SYMBOLS else 0.0

    def score(self, text):
        s = symbols(text)
        k = likelihood.ORDER
        return sum(math.log10(self.p(tuple(s[i : i + k]), s[i + k])) for i in range(len(s) - k))


def plain_base(learnt, text):
    words = lambda t: [w for w in (t or "").encode().lower().split()] + [b""]
    counts = Counter(w for t in learnt for w in words(t))
    n, v = sum(counts.values()), len(counts)
    own = words(text)
    return len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)


@pytest.mark.parametrize("part, block", [(likelihood.PART, likelihood.BLOCK), (50, 300)])
def test_scores_are_those_of_a_plain_model(spark, monkeypatch, part, block):
    whole = likelihood.text_packs
    monkeypatch.setattr(likelihood, "text_packs", lambda docs: whole(docs, part, block))
    texts = [t for t in TEXTS if t != LONG] + [LONG[:3000], "every " + "".join(chr(c) for c in range(256))]
    docs = awkward(spark, texts + texts[:3])
    learn = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) != 2
    rows = likelihood.score_texts(docs, learn).collect()
    learnt = [t for i, t in enumerate(texts + texts[:3]) if zlib.crc32(str(i).encode()) % 7 != 2]
    model = PlainModel(learnt)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts) + 3)) and rows[0].learn == "clash"
    for r in rows:
        text = (texts + texts[:3])[r.doc_id]
        n, known, total, base = plain_base(learnt, text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(model.score(text))


def test_probabilities_sum_to_one():
    model = PlainModel(["abracadabra", "the cat", "".join(map(chr, range(256)))])
    for context in ((97, 98, 114, 97, 99, 97, 100), (1, 2, 3, 97, 98, 99, 100), (7,) * 7):
        assert sum(model.p(context[: likelihood.ORDER], s) for s in range(likelihood.SYMBOLS)) == pytest.approx(1)


def test_scores_without_rows_or_learning(spark):
    assert likelihood.score_texts(awkward(spark).limit(0), F.lit(True)).count() == 0
    r = likelihood.score_texts(awkward(spark, ["ab"]), F.lit(None).cast("boolean")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0) and r.score == pytest.approx(3 * math.log10(1 / 257))


def test_long_texts_and_repeated_ids(spark):
    docs = awkward(spark, [LONG, LONG, "other"]).withColumn("doc_id", F.lit(1).cast("long"))
    rows = likelihood.score_texts(docs, F.lit(True)).orderBy("n_tokens").collect()
    assert [r.n_tokens for r in rows] == [2, 40_001, 40_001] and rows[1].score == pytest.approx(rows[2].score)


def test_cuts_are_between_words():
    text = b"aaa bbb  " + b"c" * 500 + b" d"
    at = likelihood.cuts(text, 10)
    assert b"".join(text[i:j] for i, j in zip(at, at[1:], strict=False)) == text
    assert [w for i, j in zip(at, at[1:], strict=False) for w in text[i:j].split()] == text.split()


# divergence


def plain_audit(rows, least, top):
    import re

    groups, docs, counts = set(), Counter(), Counter()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        docs.update((lang, t) for t in set(found))
        counts.update((lang, source, t) for t in found)
    kept = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)
    out = []
    for lang, source in groups:
        terms, others = kept[lang], [s for k, s in groups if k == lang]
        total = {s: sum(counts[lang, s, t] for t in terms) for s in others}
        share = lambda n, whole: 1 + 10**9 * (n + 5) // (whole + 5 * len(terms))
        p = {s: {t: share(counts[lang, s, t], total[s]) for t in terms} for s in others}
        pairs = [(sum(abs(p[source][t] - p[s][t]) for t in terms), s) for s in others if s != source]
        more = [(p[source][t] - share(sum(counts[lang, s, t] for s in others), sum(total.values())), t) for t in terms if counts[lang, source, t]]
        for part, found, limit in (("pair", pairs, None), ("term", [x for x in more if x[0] > 0], top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return sorted(out)


@pytest.mark.parametrize("paths", [4_096, 2])
def test_audit_is_that_of_a_plain_count(spark, paths):
    rng = random.Random(3)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyzéß日"] + ["A", "a", "Ä", "ä"]
    rows = [(rng.choice(("en", "de", None)), rng.choice(("s1", "s1", "s1", "s2", "s3", "É", None)), " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(12)))) for _ in range(300)]
    rows += [("xx", "s1", "a b"), ("xx", "s2", None), ("en", "silent", "12 !?"), *[("en", "s2", "copy copy Copy")] * 40]
    rows += [("en", "s1", (("long" + "x" * 40 + " ") * 3000))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, term int")
    divergence.PATHS, held = paths, divergence.PATHS
    got = divergence.audit(df, 5, 7).select("lang", "source", "part", "item", "value", "rank").collect()
    divergence.PATHS = held
    assert sorted(map(tuple, got)) == plain_audit(rows, 5, 7)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_of_huge_counts_are_exact(spark):
    n, total, kept = 3_000_000_000_000_007, 9_000_000_000_000_011, 12_345
    found = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert found == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_slices_keep_terms_whole(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "ab cdefghijklmnop é日本語x1y" .encode()
    parts = list(divergence.slices(text))
    assert b"".join(parts) == text and [t for p in parts for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text)


# prefixes


def plain_trie(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members, out = defaultdict(list), []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    for k, ids in members.items():
        under = [u for u in members if u[: len(k)] == k]
        saving = sum((len(members[u]) - 1) * len(u[-1][1].split()) for u in under if u)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(k))
        out.append((min(ids), len(k), min(members[k[:-1]]) if k else None, len(ids), children[k], sum(not children[u] for u in under), saving, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turn_rows(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.choice((0, 1, 2, 3, 5, 8, 9, 17))):
            rows.append((c, rng.choice((t, t, None)) if c % 9 == 0 else t, rng.choice(("u", None, "")), rng.choice(("a", "a", "a b", None, "  c\td "))))
    return rows


def ordered(rows):
    convs = defaultdict(list)
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs[c].append((role or "", text or ""))
    return dict(convs)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_is_that_of_a_plain_walk(spark):
    rows = turn_rows(random.Random(8), 60)
    rows += [(c, t, "u", "same words here") for c in range(100, 130) for t in range(6)] + [(None, 0, "u", "x")] + rows[:5]
    rows += [(500, t, "u", f"long {t}") for t in range(300)] + [(501, t, "u", f"long {t}") for t in range(299)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash"))
    got = sorted(map(tuple, prefixes.trie_of(df).collect()), key=repr)
    assert got == plain_trie(ordered(rows))
    assert prefixes.trie_of(df.limit(0)).count() == 0 and prefixes.trie_of(df.where("conv_id IS NULL")).count() == 0


def test_rebuilt_conversations_share_heads(spark):
    rng = random.Random(9)
    rows = [r for r in turn_rows(rng, 90) if r[0] not in (20, 60) and (r[0] % 7 or r[1] in (0, None))] + [(-3, 0, "u", "below")]
    own = ordered(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(math.copysign(abs(c) // 20 * 20, c))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefixes.prefix_trie(*prefixes.with_shared_heads(prefixes.numbered_turns(df)))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rebuilt)


def test_conversations_without_turns_are_one_root(spark):
    lengths = spark.createDataFrame([(7, 0), (3, 0)], "conv_id long, turns long")
    none = spark.createDataFrame([], "conv_id long, at long, turn_key binary, words long")
    assert [tuple(r) for r in prefixes.prefix_trie(lengths, none).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]


def test_words_of_a_block_are_held_in_columns():
    texts = [" ".join(f"{'ab'[k % 2]}{(i * 7919 + k) % 400_000}" for k in range(5_000)) for i in range(100)]
    plain = Counter(w for t in texts for w in [*t.encode().split(), likelihood.END_WORD])
    first = likelihood.WordCounts()
    first.add(b"a", 1)
    first.sum()  # Arrow imports modules when first used
    tracemalloc.start()
    try:
        asked = likelihood.Asked()
        for i, t in enumerate(texts):
            asked.add(likelihood.Part(i, True, True, b"", t.encode()))
        held = tracemalloc.get_traced_memory()[0] - asked.codes.nbytes - asked.counts.nbytes - sum(c.nbytes for c, _ in asked.pending)
        n = dict(zip(*(asked.words.sum().column(c).to_pylist() for c in ("word", "n")), strict=True))
    finally:
        tracemalloc.stop()
    assert len(plain) > 200_000 and held < 20_000_000  # 39 MB as a dict
    assert n == plain
    sent = [b for b in asked.batches(3) if b.column("word").null_count == 0]
    assert sum(b.num_rows for b in sent) == len(plain) and max(b.num_rows for b in sent) <= likelihood.SENT


def test_tokens_are_looked_up_many_at_once(monkeypatch):
    monkeypatch.setattr(likelihood, "PENDING_WORDS", 3)
    counts = {b"": 2, b"a": 5, b"b": 0, b"c": 1}
    tokens = likelihood.Tokens(pa.array(list(counts), pa.binary()), np.array(list(counts.values())), 20)
    texts = [{b"a": 2, b"": 1}, {}, {b"b": 3, b"a": 1}, {b"": 1}]
    for t in texts:
        tokens.ask(t)
    n, known, base = (x.tolist() for x in tokens.sums())
    assert n == [3, 0, 4, 1] and known == [3, 0, 1, 1]
    assert base == pytest.approx([sum(m * math.log10((counts[w] + 1) / 20) for w, m in t.items()) for t in texts])
