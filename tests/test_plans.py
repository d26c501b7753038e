from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pairloom.shared import run_dir
from pairloom.constants import METRICS
from pairloom.operators import normalize, scoring
from pairloom.plans.experiment import evaluate, experiment, prepared
from pairloom.plans.prepare import prepare

PAIRS = "IDS bigint, sentence string, paraphrase string, quality int"


def pairs(spark, n, tag="s"):
    return spark.range(n).select(
        F.col("id").alias("IDS"),
        F.format_string(f"{tag}%d one two", "id").alias("sentence"),
        F.format_string("p%d", "id").alias("paraphrase"),
        (F.col("id") % 2).cast("int").alias("quality"),
    )


def test_wrong_requests(spark, tmp_path):
    out = str(tmp_path / "o")
    for dataset, mode, extra in [
        ("snli", "baseline", {}),
        ("mrpc", "full", {}),
        ("tpc", "baseline", {"langs": ["en"]}),
        ("tpc", "augmented", {}),
        ("quora", "augmented", {"langs": ["en"], "downsample": True}),
    ]:
        with pytest.raises(ValueError):
            prepare(spark, dataset, mode, {}, out, **extra)


def test_mrpc_baseline_downsampled(spark, tmp_path):
    sources = {"train": pairs(spark, 300), "test": pairs(spark, 30)}
    sizes = prepare(spark, "mrpc", "baseline", sources, str(tmp_path / "o"), downsample=True)
    assert sizes == {"train": 80, "dev": 20, "test": 30}


def test_tpc_baseline_downsampled(spark, tmp_path):
    raw = spark.range(700).select(
        F.col("id").alias("IDS"),
        F.lit("a").alias("c0"),
        F.lit("b").alias("c1"),
        F.format_string("(%d, 6)", F.col("id") % 7).alias("c2"),
    )
    sources = {"train": raw, "test": raw}
    sizes = prepare(spark, "tpc", "baseline", sources, str(tmp_path / "o"), downsample=True, fmt="csv")
    assert sizes == {"train": 80, "dev": 20, "test": 600}


def test_quora_baseline_downsampled(spark, tmp_path):
    raw = pairs(spark, 500).toDF("id", "question1", "question2", "is_duplicate")
    sizes = prepare(spark, "quora", "baseline", {"all": raw}, str(tmp_path / "o"), downsample=True)
    assert sizes == {"train": 80, "dev": 20, "test": 100}
    sizes = prepare(spark, "quora", "baseline", {"all": raw}, str(tmp_path / "p"))
    assert sizes == {"train": 300, "dev": 100, "test": 100}


def test_experiment(spark, tmp_path):
    train = pairs(spark, 200).withColumns({"lang": F.lit("en"), "index": F.col("IDS")})
    foreign = pairs(spark, 100, "f").withColumns({"lang": F.lit("es"), "index": F.col("IDS")})
    augmented = train.unionByName(foreign.withColumn("IDS", F.col("IDS") + 200))
    raw = pairs(spark, 200).withColumnsRenamed(
        {"IDS": "id", "sentence": "question1", "paraphrase": "question2", "quality": "is_duplicate"}
    )
    sources = {"all": raw, "augmented": augmented, "dev": pairs(spark, 20), "test": pairs(spark, 40)}

    def classifier(train):
        model = scoring.fit_classifier(train, features=64, iterations=3)
        return lambda test: scoring.classify(model, test)

    def rule(train):
        return lambda test: test.withColumn("pred", F.col("quality"))

    records = str(tmp_path / "records")
    results, board = experiment(
        {"quora": prepared(spark, "quora", sources)}, {"bert": classifier, "albert": rule}, ["es"], records
    )
    assert results.count() == 4 and board.count() == 4
    assert all(r[m] == 1.0 for r in results.filter("model = 'albert'").collect() for m in METRICS)
    assert spark.read.json(records).count() == 4


def test_experiment_filters_before_it_drops_duplicates(spark):
    rows = [(0, "a", "b", 1, "en", 0), (1, "c", "d", 1, "ko", 0), (2, "c", "d", 1, "es", 0)]
    made = spark.createDataFrame(rows, "IDS bigint, sentence string, paraphrase string, quality int, lang string, index bigint")
    other = pairs(spark, 10)
    corpus = prepared(spark, "quora", {"augmented": made, "dev": other, "test": other})
    for langs, want in ((["en", "es"], {0, 2}), (["en", "ko"], {0, 1}), (["en", "es", "ko"], {0, 1})):
        assert {r.IDS for r in corpus(langs).filter("split = 'train'").collect()} == want


def test_evaluate_needs_every_partner(spark):
    preds = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 2), (5, 1)], "IDS bigint, pred int")
    gold = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1), (9, 0)], "IDS bigint, quality int")
    config = {"dataset": "d", "model": "m", "langs": "en"}
    with pytest.raises(Exception, match="not 0 or 1"):
        evaluate(preds, gold, config).collect()
    found = {r.key: r.value for r in evaluate(preds, gold, config, unmatched="count").collect()}
    assert (found["n_only_pred"], found["n_only_gold"], found["n_invalid"]) == (1, 1, 2)
    assert found["accuracy"] == 0.5
    ok = evaluate(preds.filter("IDS < 3"), gold.filter("IDS < 3"), config)
    assert "n_invalid" not in {r.key for r in ok.collect()}


def test_normalisers_accept_a_stream(spark, tmp_path):
    raw = spark.range(70).select(
        F.col("id").alias("IDS"),
        F.lit("a").alias("c0"),
        F.lit("b").alias("c1"),
        F.format_string("(%d, 6)", F.col("id") % 7).alias("c2"),
    )
    raw.write.parquet(str(tmp_path / "raw"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "raw"))
    query = (
        normalize.normalize_twitter(stream)
        .writeStream.option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True)
        .start(path=str(tmp_path / "out"), format="parquet")
    )
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 60 and found.filter("quality = 1").count() == 30


def test_an_experiment_deletes_its_corpora(spark):
    """A corpus is scored when it is made, and deleted before the next one is."""
    def left():
        return {d for d, _, _ in os.walk(run_dir(spark)) if os.path.basename(d).startswith("quora-")}

    train = pairs(spark, 100).withColumns({"lang": F.lit("en"), "index": F.col("IDS")})
    raw = pairs(spark, 100).withColumnsRenamed({"IDS": "id", "sentence": "question1", "paraphrase": "question2", "quality": "is_duplicate"})
    make, before, seen = prepared(spark, "quora", {"all": raw, "augmented": train, "dev": pairs(spark, 20), "test": pairs(spark, 40)}), left(), []

    def corpus(langs):
        seen.append(len(left() - before))
        return make(langs)

    rule = lambda train: lambda test: test.withColumn("pred", F.col("quality"))
    results, _ = experiment({"quora": corpus}, {"albert": rule}, ["es", "ko"])
    assert seen == [0, 0, 0] and left() == before
    assert results.count() == 3 and {r.accuracy for r in results.collect()} == {1.0}
