"""What a task holds at once: batches, pieces and shards bounded by their bytes."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import decontaminate
from pairloom.llm.text import BATCH_BYTES, filled, pieces, small_batches, with_columns

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def batch_limit(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def test_batches_are_bounded_by_bytes(spark, batch_limit):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('word ', 800) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    with_columns(docs, "text", "n bigint", lambda piece: {"n": np.ones(piece.num_rows, dtype=np.int64)})
    got = docs.mapInArrow(sizes, "rows bigint, bytes bigint").collect()
    assert sum(r.rows for r in got) == 3000
    assert max(r.bytes for r in got) < 1.5 * BATCH_BYTES


def test_a_sessions_own_limit_stays(spark, batch_limit):
    spark.conf.set(KEY, "7m")
    small_batches(spark)
    assert spark.conf.get(KEY) == "7m"


def test_pieces_do_not_depend_on_batches():
    rng = random.Random(1)
    texts = [rng.choice([None, "", "a" * rng.randint(0, 300), "é" * 20]) for _ in range(3000)]
    texts[77] = "x" * 9000
    whole = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    expected = [p.column(0).to_pylist() for i in range(0, 3000, 700) for p in pieces(whole.slice(i, 700), "text", 4000)]
    for n in (1, 13, 700, 3000):
        batches = (whole.slice(i, n) for i in range(0, 3000, n))
        assert [p.column(0).to_pylist() for p in filled(batches, "text", 4000, 700)] == expected
    assert list(filled(iter([]), "text", 4000)) == list(filled(iter([whole.slice(0, 0)]), "text", 4000)) == []


def test_few_items_are_searched_in_small_shards(spark, monkeypatch):
    limits = []
    real = decontaminate.with_columns
    monkeypatch.setattr(decontaminate, "with_columns", lambda *args, **options: limits.append(options["limit"]) or real(*args, **options))
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f")], "doc_id bigint, text string")
    items = spark.createDataFrame([("x", "b c"), ("y", "q")], "item_id string, text string")
    monkeypatch.setattr(decontaminate, "LEAST_SHARD", 16)
    for most, limit in ((1 << 20, 24), (20, 20)):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", most)
        rows = {r.doc_id: r.hit_items for r in decontaminate.find_leaks(docs, items).collect()}
        assert rows == {1: ["x"], 2: []} and limits.pop() == limit
    assert not limits
