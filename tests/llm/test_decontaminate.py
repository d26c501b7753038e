from __future__ import annotations

import random
import re

import numpy as np
import pytest

from pairloom.llm import decontaminate
from pairloom.llm.decontaminate import find_leaks, remove_leaks, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(texts, items, window):
    """Per text: words, hit words, items; and the longest match of at least a window."""
    out = []
    tests = [(str(k), words(t)) for k, t in items]
    for text in texts:
        w = words(text)
        hit, held, longest = set(), set(), 0
        for key, t in tests:
            size = min(window, len(t))
            if not size:
                continue
            wins = {tuple(t[i : i + size]) for i in range(len(t) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wins:
                    hit.update(range(i, i + size))
                    held.add(key)
                    for p in range(len(t) - size + 1):
                        n = 0
                        while p + n < len(t) and i + n < len(w) and t[p + n] == w[i + n]:
                            n += 1
                        if n >= size:
                            longest = max(longest, n)
        out.append((len(w), len(hit), sorted(held), longest))
    return out


def sample(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "é", "The", "x1", "of", "ß"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.randint(1, 14))) for i in range(12)] + [(12, None), (13, ""), (14, "!!"), (3, line(9))]
    texts = [line(rng.randint(0, 80)) for _ in range(n)]
    texts += [None, "", "...", items[4][1], f"zz {items[5][1].upper()}, {items[6][1]}! zz", "a " * 3000, texts[0]]
    return texts, items


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for high, n in ((2, 500), (5, 300), (1000, 400), (1, 64)):
        ranks = rng.integers(0, high, n)
        order = suffix_array(ranks, 9)
        keys = [tuple([*ranks[i : i + 9], *[0] * 9][:9]) for i in order]
        assert sorted(order) == list(range(n))
        assert keys == sorted(keys)


@pytest.mark.parametrize("window,shard,block", [(10, 1 << 20, 1 << 20), (3, 700, 1 << 20), (4, 300, 60)])
def test_against_brute_force(spark, docs_of, monkeypatch, window, shard, block):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    monkeypatch.setattr(decontaminate, "TEST_BYTES", block)
    texts, items = sample()
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    # an item in two rows is matched row by row, and counts once
    want = brute(texts, items, window)
    got = {}
    for r in find_leaks(docs_of(texts), tests, window=window, keep=["doc_id"]).collect():
        hit = sum(b - a for a, b in zip(r.hit_from, r.hit_to))
        assert all(b < c for b, c in zip(r.hit_to, r.hit_from[1:]))
        got[r.doc_id] = (r.n_words, hit, sorted(r.hit_items), r.longest_match)
        if r.longest_match:
            run = words(texts[r.doc_id])[r.longest_at : r.longest_at + r.longest_match]
            assert any(" ".join(run) in " ".join(words(t)) for k, t in items if str(k) == r.longest_item)
    assert [got[i] for i in range(len(texts))] == want
    assert any(x[1] for x in want) and not all(x[1] for x in want)


def test_removal_keeps_clean_rows_and_their_columns(spark, docs_of):
    leak = "one two three four five six seven eight nine ten eleven"
    docs = docs_of([leak, f"so {leak.upper()} it", leak[:-12], None, "clean", "clean"])
    docs = docs.selectExpr("*", "1 as n_words", "text as hit_items")
    tests = spark.createDataFrame([(7, leak)], "item_id bigint, text string")
    out = remove_leaks(docs, tests)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 4, 5]
    assert {r.hit_items for r in out.collect()} == {leak[:-12], None, "clean"}


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert find_leaks(docs_of([]), none).count() == 0
    rows = find_leaks(docs_of(["a b", None]), none).collect()
    assert sorted((r.n_words, r.hit_items, r.longest_match) for r in rows) == [(0, [], 0), (2, [], 0)]
