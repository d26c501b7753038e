from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import language_model
from pairloom.llm.language_model import ADD, BASE, TRUST, WEIGHT, Part, score


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["</s>"]


def value(count):
    level = 0 if not count else 1 + math.floor(math.log(count) / math.log(BASE) + 1e-9)
    return level if level <= 1 else BASE ** (level - 0.5)


def brute(texts, train):
    uni, bi = Counter(), Counter()
    for t, used in zip(texts, train):
        if used:
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    out = []
    for t in texts:
        w = tokens(t)
        base = sum(math.log10((uni[x] + ADD) / (n + ADD * (v + 1))) for x in w)
        total = 0.0
        for h, x in zip(["<s>", *w], w):
            c = sum(train) if h == "<s>" else value(uni[h])
            weight = WEIGHT * c / (c + TRUST)
            seen = min(value(bi[(h, x)]) / max(c, 1.0), 1.0)
            total += math.log10(weight * seen + (1 - weight) * (value(uni[x]) + ADD) / (n + ADD * (v + 1)))
        out.append((len(w), sum(uni[x] > 0 for x in w), n, base, total))
    return out


def sample():
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(3000)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [line(rng.randint(0, 60)) for _ in range(150)]
    texts += [None, "", " \n\t", "Ünïcode É wOrd", "the " * 3000, texts[0], texts[0], "x" * 4000]
    return texts, [i % 4 != 0 for i in range(len(texts))]


@pytest.mark.parametrize("pass_bytes,piece", [(1 << 30, 1 << 20), (1500, 700)])
def test_against_exact_counts(spark, docs_of, monkeypatch, pass_bytes, piece):
    monkeypatch.setattr(language_model, "SCORE_BYTES", piece)
    monkeypatch.setattr(language_model, "FLUSH_TOKENS", 500)
    texts, train = sample()
    docs = docs_of(texts).selectExpr("*", "1 as score", "text as n_known")
    out = score(docs, F.col("doc_id") % 4 != 0, pass_bytes=pass_bytes)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = {r.doc_id: r for r in out.collect()}
    want = brute(texts, train)
    assert len(got) == len(texts)
    close = 0
    for i, (n, known, total, base, model) in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        # the filter never underestimates, and seldom overestimates
        close += abs(r.score - model) <= 1e-6 * max(1, abs(model))
        assert r.score == pytest.approx(model, rel=0.05, abs=0.5)
    assert close > 0.7 * len(texts)


def test_filter_never_underestimates():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    counts = rng.zipf(1.5, 5000).clip(1, 10**6)
    n = 4
    import pyarrow as pa

    rows = []
    for s in range(n):
        own = keys % np.uint64(n) == s
        table = pa.table(
            {
                "order": pa.array([1], pa.int32()),
                "slice": pa.array([s], pa.int32()),
                "keys": pa.array([keys[own].tobytes()], pa.binary()),
                "counts": pa.array([counts[own].astype(np.uint32).tobytes()], pa.binary()),
            }
        )
        rows += language_model._build_slice(table).to_pylist()
    sizes = [{**r, "filter_bytes": len(r["filter"]), "key_bytes": len(r["keys"])} for r in rows]
    part = Part.received(vars(Part(rows, sizes, n)))
    assert (part.exact(keys) == counts).all()
    levels, true = part.levels(1, keys), language_model._levels(counts)
    assert (levels >= true).all() and (levels == true).mean() > 0.97
    other = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    assert (part.levels(1, other) == 0).mean() > 0.985 and (part.exact(other) == 0).all()


def test_nothing_to_learn_from(spark, docs_of):
    rows = score(docs_of(["a b", None]), F.lit(None).cast("boolean")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 0, 0), (3, 0, 0)]
    assert score(docs_of([]), F.lit(True)).count() == 0
