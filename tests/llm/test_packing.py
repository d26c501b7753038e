from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import packing
from pairloom.llm.packing import END, Bm25, Encoder, content_places, cuts, fill_order, pack, pack_shard
from pairloom.llm.queries import tokenizer_path

TEXTS = [
    "Hello, world! It's 12,345.67 don't WE'LL you've", "", None, "<|endoftext|> x<|startoftext|>y. <|ENDOFTEXT|> <| a|>",
    "é́ É naïve. Ünïcode… “quoted” l’eau", "a b c\x85d e\x0bf\x1cg", "= ≠ ≠ .́ á. 5́.", "日本語。テスト!!",
    "a.b.c... !!! ?! x% y$ z# w& v* 'tis ''s 's.", "\n\t tabs \r\n", "word " * 3000, "İstanbul ǅ ﬁ ẞ", "$5.00, #1 a1. 1a. ₂. ½. ²,",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("known", [10**6, 50])
def test_chunks_give_the_tokenizers_ids(tokenizer, monkeypatch, known):
    monkeypatch.setattr(packing, "KNOWN_CHUNKS", known)
    rng = random.Random(5)
    alphabet = list("aBé.,;!'%$ \ń<|>s1½") + ["<|endoftext|>", "'ll", "  "]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = Encoder(f.read())
    for group in (texts[:40], texts, texts):
        ids, first, _, _ = encoder.encode(pa.array(group, pa.string()))
        for i, t in enumerate(group):
            assert ids[first[i] : first[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [END]


def test_signs_between_chunks(tokenizer):
    """Chunks with the sign that is sent between them, and hashes whose upper bits agree."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = Encoder(f.read())
    assert encoder.by_chunk and encoder.sign is not None
    texts = ["~", "a ~ b", "a~b ~~ ~c.", "x " * 250 + "~", "", None, "<|endoftext|> ~ <|"]
    signed = encoder.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own = signed[0][signed[1][i] : signed[1][i + 1]].tolist()
        assert own == tokenizer.encode(t or "", add_special_tokens=False).ids + [END]
    assert (encoder.order == np.argsort(signed[2], kind="stable")).all()
    encoder.clear()
    encoder.sign = None  # as for a tokenizer without it
    assert all((x == y).all() for x, y in zip(signed, encoder.encode(pa.array(texts, pa.string())), strict=True))
    rng = np.random.default_rng(3)
    for hashes in (rng.integers(0, 9, 500), (1 << 60) + rng.integers(0, 4, 50), rng.integers(0, 1 << 62, 50), np.zeros(0)):
        hashes = hashes.astype(np.uint64)
        assert (packing.stable_order(hashes) == np.argsort(hashes, kind="stable")).all()


def test_best_neighbours_come_first(monkeypatch):
    rng = np.random.default_rng(4)
    terms, doc = rng.integers(0, 40, 3000).astype(np.uint64), np.sort(rng.integers(0, 300, 3000))
    index, unused = Bm25(terms, doc, 300), rng.random(300) < 0.8
    counts = rng.integers(1, 40, 300)
    for seed in range(20):
        whole = index.neighbours(seed, unused)
        assert (index.neighbours(seed, unused, 8) == whole[: len(index.neighbours(seed, unused, 8))]).all()
        assert len(index.neighbours(seed, unused, 8)) >= min(8, len(whole))
    orders = []
    for best in (1, 5, 10**6):
        monkeypatch.setattr(packing, "BEST", best)
        orders.append(fill_order(index, counts, 256).tolist())
    assert orders[0] == orders[1] == orders[2]


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import models, pre_tokenizers

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    assert Encoder(spec).by_chunk
    vocabulary = {"[UNK]": 0, "a": 1, "b": 2, "a.": 3, "<|startoftext|>": 4, " ": 5, "c.": 6, ".": 7}
    plain = Tokenizer(models.WordLevel({k: v for k, v in vocabulary.items() if v < 4}, unk_token="[UNK]"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    joined = Tokenizer(models.WordLevel(vocabulary, unk_token="[UNK]"))  # no splitting: one token a text
    joined.add_special_tokens(["<|startoftext|>"])
    masked = Tokenizer.from_str(spec)
    masked.add_special_tokens(["[MASK]"])
    texts = ["a b a.", "", None, "a", "c.", "a [MASK] b", "a\nb <|startoftext|>"]
    for own in (plain, joined, masked):
        encoder = Encoder(own.to_str())
        assert not encoder.by_chunk
        ids, first, terms, text = encoder.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == own.encode(t or "", add_special_tokens=False).ids + [END]
        assert len(terms) == len(text)


def test_bm25_against_formula():
    rng = np.random.default_rng(3)
    n = 40
    doc = np.sort(rng.integers(0, n, 900))
    terms = rng.zipf(1.4, 900).astype(np.uint64) % np.uint64(150)
    index = Bm25(terms, doc, n)
    length = np.bincount(doc, minlength=n)
    for seed in range(0, n, 7):
        own = set(terms[doc == seed].tolist())
        weight = {}
        for t in own:
            tf = np.bincount(doc[terms == t], minlength=n)
            df = (tf > 0).sum()
            idf = np.log1p((n - df + 0.5) / (df + 0.5))
            w = idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * length / length.mean()))
            if df > 1:
                weight[t] = w
        score = sum(weight.values(), np.zeros(n))
        unused = rng.random(n) < 0.7
        got = index.neighbours(seed, unused)
        assert set(got) == set(np.flatnonzero((score > 0) & unused))
        assert (np.diff(score[got]) <= 1e-4).all()


def test_neighbours_share_windows():
    topics = [np.arange(t * 50, t * 50 + 50, dtype=np.uint64) for t in range(4)]
    rng = np.random.default_rng(1)
    doc = np.repeat(np.arange(40), 20)
    terms = np.concatenate([rng.choice(topics[i % 4], 20) for i in range(40)])
    counts = np.full(40, 100)
    order = fill_order(Bm25(terms, doc, 40), counts, 1000)
    assert sorted(order) == list(range(40))
    same = [len({d % 4 for d in order[i : i + 10]}) for i in range(0, 40, 10)]
    assert max(same) <= 2


def test_content_places_are_least_hashes():
    texts = ["b a", "a  B a", None, "", "a b c d", "c", "\n", "d c b a"]
    first, second = content_places(pa.array(texts))
    single = {w: [x[0] for x in content_places(pa.array([w]))] for w in "abcd"}
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        for j, got in enumerate((first, second)):
            assert got[i] == min((single[w][j] for w in words), default=np.iinfo(np.int64).max)
    assert (first[0], second[0]) == (first[1], second[1]) and single["a"][0] != single["a"][1]


def test_near_copies_meet_in_a_shard(spark, docs_of, monkeypatch):
    """Near copies far apart in the input are packed next to each other."""
    monkeypatch.setattr(packing, "SHARD_BYTES", 20_000)
    rng = random.Random(4)
    groups = [[rng.choice("abcdefgh") + str(rng.randint(0, 5000)) for _ in range(80)] for _ in range(60)]
    rows = []
    for copy in range(5):
        for g, words in enumerate(groups):
            changed = [w if rng.random() > 0.03 else f"new{rng.random()}" for w in words]
            rows.append((copy * 60 + g, " ".join(changed), "en", "s", 1))
    out = pack(docs_of(rows, partitions=7), tokenizer_path(), window=1024).select("doc_id", "sequence_id").collect()
    sequences = {}
    for r in out:
        sequences.setdefault(r.doc_id, set()).add(r.sequence_id)
    near = [any(abs(a - b) <= 1 for a in sequences[d] for o in range(d % 60, 300, 60) if o != d for b in sequences[o]) for d in range(300)]
    assert sum(near) > 0.8 * len(near)


def test_one_content_is_spread(spark, docs_of):
    """Equal rows, a third without a key, are dealt to several tasks and none is lost."""
    rows = [(None if i % 3 == 0 else 7, "same words", "en", "s", 1) for i in range(3000)]
    out = pack(docs_of(rows), tokenizer_path(), window=64)
    assert out.filter("start = 0").count() == 3000
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("window", [8, 64])
def test_shards_are_cut_without_loss(window):
    rng = np.random.default_rng(window)
    for n in (1, 2, 30):
        counts = rng.integers(1, 50, n)
        row, start, length, sequence, offset = pack_shard(counts, rng.permutation(n), window)
        for d in range(n):
            own = np.flatnonzero(row == d)
            own = own[np.argsort(start[own])]
            assert start[own].tolist() == np.concatenate([[0], np.cumsum(length[own])[:-1]]).tolist()
            assert length[own].sum() == counts[d]
        for s in np.unique(sequence):
            own = np.flatnonzero(sequence == s)
            own = own[np.argsort(offset[own])]
            total = int(length[own].sum())
            assert offset[own].tolist() == np.concatenate([[0], np.cumsum(length[own])[:-1]]).tolist()
            assert total <= window and total & (total - 1) == 0
    assert cuts(0, 8).tolist() == [0] and cuts(21, 8).tolist() == [0, 8, 16, 20, 21]


def test_round_trip(spark, docs_of, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 3000)
    rng = random.Random(1)
    words = ["alpha", "Beta,", "gamma.", "délta", "12", "x" * 30]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "no key", "en", "s", 1)]
    out = pack(docs_of(rows).selectExpr("*", "1 as start", "2 as ids"), tokenizer_path(), window=256).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        assert len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text, *_ in rows:
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [END]
        assert all(r.doc_tokens == len(ids) for r in pieces)
    full = tokens = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert total <= 256 and total & (total - 1) == 0
        full, tokens = full + (total == 256), tokens + total
    assert full * 256 > 0.7 * tokens
    again = pack(docs_of(rows), tokenizer_path(), window=256).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_empty(spark, docs_of):
    assert pack(docs_of([]), tokenizer_path()).count() == 0
    rows = pack(docs_of([None, "", "a", "a"]), tokenizer_path()).collect()
    assert sorted(r.doc_tokens for r in rows) == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        pack(docs_of(["a"]), tokenizer_path(), window=100)
