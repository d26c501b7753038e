"""The pipeline's stages on the small tables with planted cases, against brute force."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_leaks
from test_similarity import brute as brute_classes
from tokenizers import Tokenizer

from pairloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input folder, planted ids, and what every stage returns."""
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    planted = {10001: items[0], 10002: f"So. {items[1].upper()} So."}
    schema = docs.schema
    rows = [(i, t, "en", "planted", len(t)) for i, t in planted.items()]
    docs.unionByName(spark.createDataFrame(rows, schema)).write.parquet(f"{sf_dir}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{sf_dir}/{name}.parquet")
    kept = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(f"{sf_dir}/stage{i}")
        kept.append(spark.read.parquet(f"{sf_dir}/stage{i}"))
    return sf_dir, kept


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    _, kept = stages
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == kept[0].columns for df in kept[1:5])


def test_classifiers_keep_good_documents(spark, stages):
    sf_dir, kept = stages
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    for before, after, label, good in ((0, 1, "quality", 1), (1, 2, "toxic", 0)):
        left = {r.doc_id for r in kept[after].select("doc_id").collect()}
        rows = kept[before].join(labels, "doc_id").filter(held).select("doc_id", label).collect()
        assert left <= {r.doc_id for r in kept[before].select("doc_id").collect()}
        good_ones = [r.doc_id in left for r in rows if r[label] == good]
        assert sum(good_ones) >= 0.95 * len(good_ones)
    assert kept[1].count() < kept[0].count() and kept[2].count() < kept[1].count()


def test_one_document_of_each_class_stays(stages):
    _, kept = stages
    before, after = texts_of(kept[2]), set(texts_of(kept[3]))
    ids = sorted(before)
    classes = brute_classes([before[i] for i in ids], 5, 80, 100)
    assert after == {ids[c] for _, c in classes}


def test_leaks_go(spark, stages):
    sf_dir, kept = stages
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = texts_of(kept[3]), set(texts_of(kept[4]))
    found = brute_leaks(list(before.values()), items, 10)
    assert after == {i for i, leak in zip(before, found) if not leak[1]}
    assert not after & {10001, 10002}


def test_sequences_hold_every_token(stages):
    _, kept = stages
    tokenizer, texts = Tokenizer.from_file(tokenizer_path()), texts_of(kept[4])
    pieces = {}
    for r in kept[5].orderBy("doc_id", "start").collect():
        pieces.setdefault(r.doc_id, []).append(r.ids)
    assert pieces.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.frombuffer(b"".join(pieces[i]), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_run_gives_the_last_stage(spark, stages):
    sf_dir, kept = stages
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == kept[5].columns
    digest = lambda df: df.agg(F.count("*"), F.sum("length"), F.count_distinct("doc_id")).first()
    assert digest(out) == digest(kept[5])
