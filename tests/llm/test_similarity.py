from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import similarity
from pairloom.llm.components import components
from pairloom.llm.similarity import bitmaps, one_of_each, shingle_sets, signatures, similar_documents


def brute(texts, words, num, den):
    sets = []
    for t in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def sample(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(12))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.55 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w).upper() if kind < 0.1 else "\n ".join(w))
        else:
            own = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 20, 60, 150])))
            texts.append(f"{own} {passage}" if kind > 0.8 else own)
    return texts + ["", None, " \n", "a b c", "A b C", "x " * 4000, "x " * 3000]


@pytest.mark.parametrize("seed,words,threshold,block", [(1, 4, (85, 100), 2048), (2, 5, (80, 100), 4), (3, 2, (60, 100), 3)])
def test_against_all_pairs(spark, docs_of, monkeypatch, seed, words, threshold, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "SETS", block)
    monkeypatch.setattr(similarity, "FLUSH", 500)
    texts = sample(seed)
    out = similar_documents(docs_of(texts).selectExpr("*", "1 as n", "2 as set_id"), words=words, threshold=threshold)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    want = brute(texts, words, *threshold)
    assert [got[i] for i in range(len(texts))] == want
    assert len({c for _, c in want}) < len(texts)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for num, den in ((85, 100), (80, 100), (50, 100)):
        for _ in range(200):
            a = rng.integers(1, 2**62, rng.integers(1, 80), dtype=np.uint64)
            b = np.unique(np.concatenate([a[: rng.integers(1, len(a) + 1)], rng.integers(1, 2**62, rng.integers(0, 8), dtype=np.uint64)]))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            key, of = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, den)
            if den * common >= num * (len(a) + len(b) - common):
                assert set(key[of == 0].tolist()) & set(key[of == 1].tolist())
            bits = bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(a) + len(b) - 2 * common


def test_odd_rows(spark, docs_of):
    rows = [(1, "a b c d e", "en", "s", 1), (1, "a b c d e", "en", "s", 1), (None, "a b c d e", "en", "s", 1), (5, "q", "en", "s", 1), (5, "r s", "en", "s", 1), (None, "z", None, None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(docs_of(rows)).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, 1), (5, 1, 5), (5, 1, 5), (None, 1, None)], key=str)
    assert similar_documents(docs_of([])).count() == 0


def test_one_of_each(spark, docs_of):
    base = " ".join(f"w{i}" for i in range(60))
    docs = docs_of([base, base + " x", base.upper(), "clean one", None, "clean two"]).selectExpr("*", "1 as n_shingles")
    out = one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 3, 4, 5]


def test_one_of_each_with_shared_and_null_keys(spark, docs_of):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (0, base), (0, base), (1, base + " x"),  # repeated rows that are the first of their class
        (5, base + " y"), (5, "clean five"),  # a key of a copy and of a clean text
        (None, "no key"), (None, "no key"), (None, base), (None, "also none"),
        (7, None), (7, ""), (None, None), (8, "clean eight"), (9, "clean eight"),
    ]
    docs = docs_of([(*r, "en", "s", 1) for r in rows])
    out = one_of_each(docs)
    want = [(0, base), (5, "clean five"), (None, "no key"), (None, "also none"), (7, None), (7, ""), (None, None), (8, "clean eight")]
    assert out.columns == docs.columns and sorted(map(str, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(str, want))


def test_every_link_is_counted(spark, docs_of, monkeypatch):
    monkeypatch.setattr(similarity, "SETS", 16)  # several blocks of a component
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(40)] + [" ".join(base)] * 3 + ["a b", "a B", "c", None]
    texts += [" ".join(f"y{i}" for i in range(k, k + 40)) for k in range(0, 30, 3)]
    words = [(t or "").lower().split() for t in texts]
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset() for w in words]
    near = lambda a, b: a and b and a != b and 100 * len(a & b) >= 70 * len(a | b)
    want = [sum(bool(near(a, b)) for b in set(sets)) for a in sets]
    got = {r.doc_id: r.n_links for r in similar_documents(docs_of(texts), words=4, threshold=(70, 100)).collect()}
    assert [got[i] for i in range(len(texts))] == want and max(want) > 20


def test_common_elements(monkeypatch):
    monkeypatch.setattr(similarity, "COLUMNS", 8)
    rng = np.random.default_rng(4)
    sides = [[np.unique(rng.zipf(1.3, rng.integers(1, 60)) % 90) for _ in range(n)] for n in (30, 20)]
    flat = [(np.repeat(np.arange(len(s)), [len(x) for x in s]), np.concatenate(s), len(s)) for s in sides]
    want = [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
    for postings in (0, 40, 10**6):
        monkeypatch.setattr(similarity, "POSTINGS", postings)
        assert similarity._common(*flat[0], *flat[1]).tolist() == want


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    label = {}

    def find(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in label}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bitmaps_of_all_lengths():
    """Folded bitmaps are those of the shorter length, and unlike large sets are told apart."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(1, 2**62, n, dtype=np.uint64)) for n in (1, 2000, 2048, 2049, 9000, 9000, 40_000)]
    sets.append(np.unique(np.concatenate([sets[4][:8500], rng.integers(1, 2**62, 300, dtype=np.uint64)])))
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    own = similarity.Bitmaps([b.tobytes() for b in bitmaps(np.concatenate(sets), first)])
    i, j = np.triu_indices(len(sets), 1)
    differ = own.differing(i, j)
    for a, b, d in zip(i, j, differ):
        assert d <= len(np.setxor1d(sets[a], sets[b]))
    pair = {(a, b): d for a, b, d in zip(i.tolist(), j.tolist(), differ.tolist())}
    assert pair[4, 7] <= 800 and pair[4, 5] > 18_000 * 20 // 180
