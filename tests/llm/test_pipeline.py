"""Each stage of the pipeline against a plain version on whole small tables, and on awkward ones."""

import re

import numpy as np
import pytest

import corpus_pipeline as pipeline
from fieldscan.llm import packing, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def kept(df):
    return sorted(r.doc_id for r in df.collect())


def fold(text, separators):
    return [w for w in re.split(separators, (text or "").translate(simhash.FOLD)) if w]


def test_toxic_documents_go(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    terms, weights = toxicity.train(docs, labels.selectExpr("doc_id", "toxic AS label"))
    scanner = toxicity.Scanner(terms)
    score = lambda t: 1 / (1 + np.exp(-(np.dot(scanner.features(t), weights[:-1]) + weights[-1])))
    assert kept(pipeline.drop_toxic(spark, docs, SF)) == sorted(i for i, t in texts.items() if not weights or score(t) < pipeline.TOXIC)
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(clean - set(kept(pipeline.drop_toxic(spark, docs, SF)))) <= len(clean) // 50


def test_one_document_of_each_group_stays(spark, docs, texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").translate(simhash.FOLD).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and ((texts[i] or "") == (texts[j] or "") or sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert kept(pipeline.keep_one_of_group(spark, docs, SF)) == sorted(i for i, v in label.items() if i == v)


def test_benchmark_documents_go(spark, docs, texts):
    separators = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = fold(r.text, separators)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = fold(text, separators)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    want = sorted(i for i, t in texts.items() if not hit(t))
    assert kept(pipeline.cut_benchmark(spark, docs, SF)) == want and 0 < len(want) < len(texts)


def test_secrets_are_masked_and_other_text_stays(spark, docs, texts):
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""", re.A)
    others = re.compile(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}")
    out = {r.doc_id: r for r in pipeline.mask_secrets(spark, docs, SF).collect()}
    assert set(out) == set(texts)
    for i, r in out.items():
        text = texts[i] or ""
        if not assign.search(text) and not others.search(text) and "[secret]" not in (r.text or ""):
            assert r.text == texts[i]
        assert not assign.search(r.text or "") and not others.search(r.text or "") and r.n_chars == (None if r.text is None else len(r.text))
        parts = (r.text or "").split("[secret]")
        assert text.startswith(parts[0]) and text.endswith(parts[-1])


def test_every_token_is_packed(spark, docs, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    pieces = pipeline.pack_sequences(spark, docs, SF).collect()
    total = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    seats = {}
    for p in pieces:
        total[p.doc_id] -= p.length
        seats.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert not any(total.values())
    for seat in seats.values():
        ends = np.cumsum([n for _, n in sorted(seat)])
        assert [at for at, _ in sorted(seat)] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_take_empty_and_awkward_tables(spark, docs, name, stage):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", None, "b", 7), (3, "one two", None, "b", 7), (3, "other words here", "en", "c", 16), (4, long, "en", "d", len(long)), (None, "a text without an id", "en", "e", 20), (5, 'token = "Zx81QkP0vW72bTgY5LmN"', "en", "f", 30)]
    awkward = spark.createDataFrame([(*r, "clash") for r in rows], KINDS + ", label string")
    out = stage(spark, awkward, SF)
    got = out.collect()
    if name == "best_fit_packing":
        assert sum(p.piece == 0 for p in got) == len(rows)
    else:
        assert out.columns == list(pipeline.COLUMNS) and {r.doc_id for r in got} >= ({1, 3, 4, 5} if name == "simhash_near_dedup" else {1, 2, 3, 4, 5})
    assert stage(spark, awkward.limit(0), SF).count() == 0


def test_copies_by_fingerprint_go(spark):
    """Texts of one fingerprint or two bits apart are linked by the second stage, though their shingles differ too much for near copies."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words)]
    for k in range(1, 400):
        other = words[:]
        for at in range(0, 12):
            other[(k + at * 33) % 400] = "x"
        near = simhash.text_fingerprint(" ".join(other)) ^ simhash.text_fingerprint(texts[0])
        if near.bit_count() <= 2:
            texts.append(" ".join(other))
            break
    assert len(texts) == 2
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in texts]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], KINDS)
    assert kept(pipeline.keep_one_of_group(spark, docs, SF)) == [0]
