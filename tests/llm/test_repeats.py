"""Runs against a search of all periods, and what is left of texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm.queries import made_periodic, op12_runs
from pairloom.llm.repeats import find_runs, runs_of


def brute(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """Runs by trying every period at every place."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                size = j - i + q
                if size >= max(least, 2 * q) and not any(
                    all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)
                ):
                    out.append((i, size, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng: random.Random, n: int) -> list[int]:
    kind = rng.randint(0, 4)
    if kind < 2:
        return [rng.randint(1, 2 + kind * 2) for _ in range(n)]
    if kind == 2:
        stretch = [rng.randint(1, 3) for _ in range(rng.randint(1, 9))]
        return [stretch[i % len(stretch)] for i in range(n)]
    if kind == 3:
        out: list[int] = []
        while len(out) < n:
            out += [rng.randint(1, 3) for _ in range(rng.randint(1, 6))] * rng.randint(1, 5)
        return out
    a, b = [1], [1, 2]  # Fibonacci word: many runs
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least", [2, 3, 5, 6, 12])
def test_all_runs(least):
    rng = random.Random(least)
    for _ in range(60):
        docs = [some_words(rng, rng.randint(0, 60)) for _ in range(rng.randint(0, 6))]
        words = np.array([x for d in docs for x in d], dtype=np.uint64)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        want = [(s + int(first[i]), n, q) for i, d in enumerate(docs) for s, n, q in brute(d, least)]
        assert [tuple(r) for r in runs_of(words, first, least).tolist()] == want


def test_long_periodic_texts():
    for words, want in (
        (np.ones(200_000, np.uint64), [[0, 200_000, 1]]),
        (np.tile(np.arange(1, 1000, dtype=np.uint64), 200), [[0, 199_800, 999]]),
    ):
        assert runs_of(words, np.array([0, len(words)])).tolist() == want


TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "a " * 11,
    "a " * 12,
    "A a " * 6,
    "x  " + "a\tb\n" * 6 + " y",
    " ".join(["p q r"] * 5 + ["s"] + ["q"] * 13 + ["p q r"] * 4),
    "é ü " * 7 + "é",
    "z " + "w1 w2 w3 " * 5000,
    "a b c d e f g " * 2 + "h",
]


def collapsed(words: list[str], runs) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_columns(docs_of):
    for r in find_runs(docs_of(TEXTS), keep=["doc_id"]).collect():
        words = words_of(TEXTS[r.doc_id])
        runs = brute(words) if len(words) < 1000 else [(1, 15000, 3)]
        assert r.n_words == len(words)
        assert [tuple(x) for x in r.runs] == runs
        assert r.collapsed == collapsed(words, runs)


def test_repeated_rows_empty_tables_and_clashing_columns(docs_of):
    docs = docs_of([(1, "a " * 12, "en", "s", 1), (1, "a " * 12, "en", "s", 1), (None, "a " * 12, None, None, None)])
    got = find_runs(docs.withColumns({"RUNS": F.lit(1), "collapsed": F.lit(2)}))
    assert [c for c in got.columns if c.lower() == "runs"] == ["runs"]
    rows = got.collect()
    assert len(rows) == 3 and {(r.n_words, r.collapsed) for r in rows} == {(12, "a")}
    assert find_runs(docs_of([])).collect() == []


def periodic(doc_id, text):
    words = words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_made_periodic(docs_of):
    texts = [None, "", "one"] + [" ".join(str(j) for j in range(i)) + "\n" for i in range(1, 300)]
    rows = made_periodic(docs_of(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert words_of(r.text) == periodic(r.doc_id, texts[r.doc_id])


def test_query(spark):
    """The whole query against the search of all periods."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op12_runs(spark, sf).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    checked = 0
    for r in rows:
        words = periodic(r.doc_id, texts[r.doc_id])
        if len(words) > 400:
            continue
        runs = brute(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == top and r.n_runs == len(runs)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(words, runs))
        checked += 1
    assert checked > 100
