from __future__ import annotations

import random

import pytest

from pairloom.operators.dedup import remove_duplicates, remove_duplicates_in_sets

SCHEMA = "IDS bigint, sentence string, paraphrase string, lang string, index bigint"


def brute(rows, by=None):
    seen, gone = set(), set()
    for r in sorted(rows):
        if (r[1], r[2]) in seen and r[3] != "en":
            gone.add(r[0] if by is None else r[4])
        seen.add((r[1], r[2]))
    return sorted(r[0] for r in rows if (r[0] if by is None else r[4]) not in gone)


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(r.IDS for r in remove_duplicates(df, **kw).collect())


def test_golden(spark):
    rows = [(0, "a", "b", "en", 0), (1, "a", "b", "es", 0), (2, "a", "b", "en", 1), (3, "a", "b", None, 1)]
    assert run(spark, rows) == [0, 2]
    assert run(spark, [(0, "a", "b", "es", 0), (1, "a", "b", "en", 0)]) == [0, 1]
    nulls = [(0, None, None, "es", 0), (1, None, None, "fr", 1), (2, "", None, "fr", 2)]
    assert run(spark, nulls) == [0, 2]


def test_random_tables_and_idempotence(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):  # a third of the rows are one pair
        s = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", None, ""])
        p = "hot" if s == "hot" else rng.choice(["x", "y", None])
        rows.append((i, s, p, rng.choice(["en", "es", "ja", None]), i // 10))
    want = brute(rows)
    for parts in (1, 8):
        assert run(spark, rows, parts) == want
    kept = [r for r in rows if r[0] in set(want)]
    assert run(spark, kept) == want
    assert {r[0] for r in rows if r[3] == "en"} <= set(want)
    assert run(spark, rows, by="index") == brute(rows, by="index")


def test_order_must_be_unique(spark):
    for rows in ([(0, "a", "b", "es", 0), (0, "c", "d", "es", 0)], [(None, "a", "b", "es", 0)]):
        with pytest.raises(ValueError, match="unique row key"):
            run(spark, rows)
    extra = spark.createDataFrame([(0, "a", "b", "es", 0)], SCHEMA).selectExpr("*", "1 as _first")
    assert remove_duplicates(extra).columns == extra.columns


def shuffled_texts(df):
    """Whether a text column passes an exchange in the plan, other than in the rows that stay."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "hashpartitioning(sentence" in line]


def test_pairs_are_grouped_without_their_texts(spark):
    rows = [(i, f"s{i % 7}", f"p{i % 5}", ["en", "es", "ja", None][i % 4], i // 10) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert not shuffled_texts(remove_duplicates(df))
    assert not shuffled_texts(remove_duplicates(df, by="index"))
    assert not shuffled_texts(remove_duplicates_in_sets(df, {"all": ["en", "es", "ja"]}))


def test_sources_with_few_and_many_copies(spark):
    """The rows of a source move together where they are few; the result is the same with many, or without a source."""
    rng = random.Random(2)
    for size in (5, 300):
        rows = [(i, rng.choice(["a", "b", None, "1:a"]), rng.choice(["x", None]), rng.choice(["en", "es", None]), i // size) for i in range(600)]
        assert run(spark, rows) == brute(rows)
        rows = [(*r[:4], None if r[0] == 7 else r[4]) for r in rows]
        assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("most", [0, 100_000])
def test_dense_keys_are_found_by_bitmaps(spark, monkeypatch, most):
    """Kept rows are found by a broadcast of their keys, so that no row moves; with too many bitmaps by a join."""
    monkeypatch.setattr("pairloom.operators.dedup.FEW_ROWS", 0)
    monkeypatch.setattr("pairloom.operators.dedup.MAX_BITMAPS", most)
    rng = random.Random(4)
    keys = rng.sample(range(-70_000, 70_000), 600) + [-32_769, -32_768, -1, 32_767, 32_768, 2**31]
    rows = [(k, rng.choice(["a", "b", "c", None]), f"p{rng.randint(0, 40)}", rng.choice(["en", "es", "ko", None]), i) for i, k in enumerate(dict.fromkeys(keys))]
    assert run(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    plan = remove_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert ("kept-keys" in plan and "Exchange hashpartitioning" not in plan) == bool(most)
    marked = remove_duplicates_in_sets(df, {"es": ["en", "es"], "all": ["en", "es", "ko"]}).collect()
    for name, codes in (("es", ("en", "es")), ("all", ("en", "es", "ko"))):
        assert sorted(r.IDS for r in marked if name in r.lang_sets) == brute([r for r in rows if r[3] in codes])
