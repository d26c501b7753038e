from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from pairloom import shared
from pairloom.operators import keys, sampling
from pairloom.operators.skew import salted_join


def ranked(ids, seed=123):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("parts", [1, 7])
def test_row_index(spark, parts):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("v")).repartition(parts)
    rows = keys.row_index(df, F.desc("v")).collect()
    assert sorted((r.IDS, r.v) for r in rows) == [(i, 4999 - i) for i in range(5000)]


@pytest.mark.parametrize("small", [1, 50, 20_000])
def test_cuts_are_exact(spark, monkeypatch, small):
    monkeypatch.setattr(keys, "SMALL_BUCKET", small)
    monkeypatch.setattr(keys, "HEX_DIGITS", 1)
    df = spark.range(900)
    order = ranked(range(900))
    wanted = [0, 1, 17, 180, 899, 900]
    cuts = keys.hash_cuts(df, "id", 123, lambda n: wanted)[0]
    rank = sampling.rank_key(F.col("id"), 123)
    for k, cut in zip(wanted, cuts):
        assert {r.id for r in df.filter(rank <= cut).collect()} == set(order[:k])


def test_repeated_keys_are_refused(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") % 2).alias("id"))
    with pytest.raises(ValueError, match="unique"):
        keys.hash_cuts(df, "id", 123, lambda n: [20])
    monkeypatch.setattr(keys, "SMALL_BUCKET", 10)
    with pytest.raises(ValueError, match="unique"):
        keys.hash_cuts(df, "id", 123, lambda n: [20])


def table(spark, n, parts=4):
    df = spark.range(n).select(
        F.col("id").alias("IDS"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("quality"),
        (F.col("id") % 20).alias("index"),
        F.when(F.col("id") % 4 < 2, F.lit("en")).when(F.col("id") % 4 == 2, F.lit("es")).alias("lang"),
    )
    return df.repartition(parts)


@pytest.mark.parametrize("n", [0, 1, 101, 1000])
def test_split_sizes(spark, n):
    held = math.ceil(0.2 * n)
    for parts in (1, 8):
        two = {r.IDS: r.split for r in sampling.split_two(table(spark, n, parts)).collect()}
        assert {i for i, s in two.items() if s == "dev"} == set(ranked(range(n))[:held])
        three = {r.IDS: r.split for r in sampling.split_three(table(spark, n, parts)).collect()}
        assert {i for i, s in three.items() if s == "test"} == set(ranked(range(n))[:held])
        assert {i for i, s in three.items() if s == "dev"} == set(ranked(range(n))[held : 2 * held])


def test_split_by_group_keeps_groups_together(spark):
    rows = sampling.split_two(table(spark, 500), group_by="index").collect()
    held = {r["index"] for r in rows if r.split == "dev"}
    assert len(held) == 4 and held.isdisjoint(r["index"] for r in rows if r.split == "train")


def test_balanced_sample(spark):
    want = set()
    for label in (0, 1):
        want |= set(ranked(i for i in range(400) if (i % 3 == 0) == bool(label))[:50])
    for parts in (1, 8):
        rows = sampling.balanced_sample(table(spark, 400, parts)).collect()
        assert {r.IDS for r in rows} == want and len(rows) == 100


def test_sample_needs_enough_rows(spark):
    with pytest.raises(ValueError, match="49"):
        sampling.balanced_sample(table(spark, 147))  # 49 positives
    with pytest.raises(ValueError, match="no rows"):
        sampling.balanced_sample(table(spark, 300).filter("quality = 0"))


def test_siblings_with_and_without_broadcast(spark):
    df = table(spark, 600)
    rows = sampling.downsample_with_siblings(df, 20).collect()
    english = [r for r in rows if r.lang == "en"]
    sources = {r["index"] for r in english}
    assert len(english) == 20
    want = {r.IDS for r in df.collect() if r.lang != "en" and r["index"] in sources}
    assert {r.IDS for r in rows if r.lang != "en"} == want
    assert {r.IDS for r in sampling.downsample_with_siblings(df, 20, broadcast_keys=0).collect()} == {r.IDS for r in rows}
    no_lang = sampling.downsample_with_siblings(df.drop("lang"), 20)
    assert no_lang.count() == 20


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    # A third of the rows share one key, another third has none.
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.col("id").cast("string"))
    big = spark.range(3000).select("id", key.alias("k"))
    small = spark.createDataFrame([("hot", 1), ("4", 2), ("7", 3), ("none", 4)], "k string, v int")
    got = salted_join(big, small, "k", "id", how, pieces=20, min_piece=10)
    want = big.join(small, "k", how)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_salted_join_splits_the_hot_key(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    small = spark.createDataFrame([(-1, 1)], "k bigint, v int")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = salted_join(big, small, "k", "id", pieces=30, min_piece=10)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1000 and max(sizes) < 700 and len(sizes) > 1


def test_numbering_does_not_depend_on_later_splits(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(30000).select(F.format_string("line %06d and some more text", "id")).coalesce(3).write.text(path)
    setting = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(setting)
    try:
        spark.conf.set(setting, 100_000)
        numbered = keys.file_row_index(spark.read.text(path))
        spark.conf.set(setting, 70_000)
        rows = numbered.orderBy("IDS").collect()
    finally:
        spark.conf.set(setting, was)
    assert [r.IDS for r in rows] == list(range(30000))
    assert [r.value for r in rows] == sorted(r.value for r in rows)


def test_row_without_a_block_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lines")
    spark.range(10).select(F.col("id").cast("string")).write.text(path)
    stored = keys.write_table
    lose = lambda df, name: stored(df.limit(0) if name == "block-starts" else df, name)
    monkeypatch.setattr(keys, "write_table", lose)
    with pytest.raises(Exception, match="no file block"):
        keys.file_row_index(spark.read.text(path)).collect()


def test_scratch_is_deleted_and_other_tables_stay(spark):
    before = shared.write_table(spark.range(3), "before")
    path = shared.fresh_path(spark, "result")
    with pytest.raises(RuntimeError), shared.scratch(spark):
        inside = shared.write_table(spark.range(5), "inside")
        inside.write.parquet(path)
        raise RuntimeError
    assert spark.read.parquet(path).count() == 5 and before.count() == 3
    with pytest.raises(Exception):
        inside.count()
    assert "scratch" not in shared.fresh_path(spark, "later")
