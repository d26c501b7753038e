from __future__ import annotations

import random
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pairloom.operators import features, scoring
from pairloom.shared import write_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "IDS bigint, sentence string, paraphrase string, quality int"


def brute_vocabulary(rows):
    counts = Counter(w for _, a, b, _ in rows for t in (a, b) for w in (t or "").lower().split())
    ordered = sorted(counts, key=lambda w: (-counts[w], w))
    return {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *ordered])}


def brute_encode(a, b, ids, max_len):
    a, b = (a or "").lower().split(), (b or "").lower().split()
    while len(a) + len(b) > max_len - 3:  # cut the longer one, the second on ties
        (a if len(a) > len(b) else b).pop()
    words = ["[CLS]", *a, "[SEP]", *b, "[SEP]"]
    pad = [0] * (max_len - len(words))
    tokens = [ids.get(w, 1) for w in words] + pad
    return tokens, [1] * len(words) + pad, [0] * (len(a) + 2) + [1] * (len(b) + 1) + pad


def sample(n=120):
    rng = random.Random(3)
    text = lambda: None if rng.random() < 0.1 else " ".join(
        rng.choice(["The", "cat", "sat", f"w{rng.randrange(40)}", "x" * 70]) for _ in range(rng.randrange(14))
    )
    return [(i, text(), text(), i % 2) for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0, "head": 10}])
@pytest.mark.parametrize("size", [None, 12])
def test_encoding(spark, limits, size):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    vocabulary = write_table(features.build_vocabulary(df, size=size), "vocabulary")
    ids = {w: i for w, i in brute_vocabulary(rows).items() if size is None or i < size}
    assert {r.word: r.id for r in vocabulary.collect()} == ids
    for max_len in (16, 15):
        found = features.encode_pairs(df, vocabulary, max_len, **limits).collect()
        assert len(found) == len(rows)
        for r in found:
            _, a, b, label = rows[r.IDS]
            want = brute_encode(a, b, ids, max_len)
            assert (r.input_ids, r.attention_mask, r.token_type_ids) == want
            assert r.label == label and r.n_tokens == sum(want[1])


def lengths():
    return lambda chunk: [[float(len(a)), float(len(b))] for a, b in chunk.fillna("").itertuples(index=False)]


def unbalanced():
    return lambda chunk: [[0.0, 0.0]] * (len(chunk) + 1)


def test_scoring(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    scored = scoring.with_predictions(scoring.score_pairs(df, lengths, batch=7)).collect()
    assert {r.IDS: r.pred for r in scored} == {
        i: int(len(b or "") > len(a or "")) for i, a, b, _ in rows
    }
    single = df.select("IDS", "quality", F.array(F.lit(0.5)).alias("logits"))
    assert scoring.with_predictions(single, regression=True).first().pred == 0.5
    with pytest.raises(Exception, match="scored"):
        scoring.score_pairs(df, unbalanced).collect()


def test_classifier_learns(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(300):
        a = rng.sample(words, 6)
        b = a[:5] + rng.sample(words, 1) if i % 2 else rng.sample(words, 6)
        rows.append((i, " ".join(a), " ".join(b), i % 2))
    df = write_table(spark.createDataFrame(rows, SCHEMA), "pairs")
    model = scoring.fit_classifier(df.filter("IDS < 200"), features=256)
    found = scoring.classify(model, df.filter("IDS >= 200"))
    assert set(found.columns) == {"IDS", "sentence", "paraphrase", "quality", "logits", "pred"}
    assert found.filter("pred = quality").count() > 80


def test_words_do_not_move(spark):
    """Rows are encoded where they are by a broadcast vocabulary; else a block asks once for each word."""
    df = write_table(spark.createDataFrame(sample(), SCHEMA).repartition(3), "pairs")
    vocabulary = write_table(features.build_vocabulary(df), "vocabulary")
    plan = features.encode_pairs(df, vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    plan = features.encode_pairs(df, vocabulary, broadcast_bytes=0, head=10)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_blocks_of_a_few_rows(spark, monkeypatch):
    monkeypatch.setattr(features, "BLOCK_ROWS", 7)
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    vocabulary = write_table(features.build_vocabulary(df), "vocabulary")
    found = features.encode_pairs(df, vocabulary, 16, broadcast_bytes=0, head=6).collect()
    ids = brute_vocabulary(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.input_ids, r.attention_mask, r.token_type_ids) == brute_encode(*rows[r.IDS][1:3], ids, 16)


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0, "head": 10}])
def test_rows_of_one_key_become_one(spark, limits):
    rows = [(1, "a b", "c", 1), (1, "a b", "c", 1), (None, "b", None, 0), (None, "b", None, 0), (2, "c", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    vocabulary = write_table(features.build_vocabulary(df), "vocabulary")
    found = {r.IDS: r for r in features.encode_pairs(df, vocabulary, 8, **limits).collect()}
    ids = brute_vocabulary(rows)
    twice = lambda words: [ids[w] for w in words for _ in range(2)]
    assert len(found) == 3 and found[2].n_tokens == 5
    assert found[1].input_ids == twice(["[CLS]", "a", "b", "[SEP]", "c", "[SEP]"])
    assert found[None].input_ids == twice(["[CLS]", "b", "[SEP]", "[SEP]"])
