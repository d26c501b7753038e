"""A packing shard's index shrinks as documents are used, and its arrays go as soon as they can."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from pairloom.llm import packing
from pairloom.llm.packing import Bm25, Encoder, fill_order
from pairloom.llm.queries import tokenizer_path


def test_used_documents_leave_the_index(monkeypatch):
    rng = np.random.default_rng(6)
    terms, doc = rng.integers(0, 60, 4000).astype(np.uint64), np.sort(rng.integers(0, 300, 4000))
    index, unused = Bm25(terms, doc, 300), rng.random(300) < 0.4
    small = index.only(unused)
    assert len(small.doc) < len(index.doc) / 2 and small.first[-1] == len(small.doc)
    for seed in range(300):
        assert (small.neighbours(seed, unused) == index.neighbours(seed, unused)).all()
    counts = rng.integers(1, 40, 300)
    orders = []
    for share in (0.0, 0.75, 1.0):
        monkeypatch.setattr(packing, "SHRUNK", share)
        orders.append(fill_order(index, counts, 256).tolist())
    assert orders[0] == orders[1] == orders[2] and sorted(orders[0]) == list(range(300))


def test_a_shard_takes_a_small_multiple_of_its_text():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = pa.array([" ".join(rng.choices(words, k=300)) for _ in range(1000)])
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = Encoder(f.read())
    encoder.encode(texts.slice(0, 200))  # the words are known from here on
    size = texts.nbytes
    tracemalloc.start()
    try:
        _, first, terms, doc = encoder.encode(texts)
        Bm25(terms, doc, len(texts), encoder.order)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 * size  # 21.5 before its arrays were let go one by one
