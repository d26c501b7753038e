from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm.features import minimise
from pairloom.llm.quality import BUCKETS, FEATURE_ROWS, SHAPES, CumulativeLink, features, fit, fit_quality, grade, select_quality
from pairloom.llm.queries import op4_quality, ratings

SF = "/root/testdata/sf0.01"


def test_thresholds_and_weights_of_known_model():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 5))
    w, cuts = np.array([1.0, -2.0, 0.5, 0.0, 1.5]), np.array([-1.5, 0.2, 2.0])
    noise = rng.logistic(size=6000)
    y = ((x @ w + noise)[:, None] > cuts).sum(1) * 2 + 1  # grades 1, 3, 5, 7
    model = fit(x, y, ridge=1e-6)
    assert model.grades == [1, 3, 5, 7]
    assert np.abs(model.weights - w).max() < 0.2 and np.abs(model.thresholds - cuts).max() < 0.2
    assert (np.diff(model.thresholds) > 0).all()
    at_least = model.at_least(x)
    assert (np.diff(at_least, axis=1) <= 0).all()
    by_grade = np.diff(np.pad(at_least, ((0, 0), (1, 1)), constant_values=((0, 0), (1, 0))), axis=1) * -1
    assert np.allclose(model.expected(x), by_grade @ np.array(model.grades))
    assert np.allclose(model.tail(x, 5), by_grade[:, 2:].sum(1)) and np.allclose(model.tail(x, 4), model.tail(x, 5))
    assert (model.tail(x, 1) == 1).all() and (model.tail(x, 8) == 0).all()
    assert np.corrcoef(model.expected(x), y)[0, 1] > 0.75


def test_one_grade_or_none():
    x = np.ones((3, 4))
    assert fit(x, np.array([2, 2, 2])).expected(x).tolist() == [2, 2, 2]
    assert fit(np.zeros((0, BUCKETS)), np.zeros(0)).tail(np.zeros((2, BUCKETS)), 1).tolist() == [0, 0]


def test_minimise_quadratic():
    a = np.diag([1.0, 10.0, 100.0])
    got = minimise(lambda p: (0.5 * (p - 1) @ a @ (p - 1), a @ (p - 1)), np.zeros(3), steps=2000)
    assert np.allclose(got, 1, atol=1e-2)


def test_features_depend_on_the_text_alone():
    texts = ["a b a b!", "", "Word word Word", "é" * 30, "x " * 5000, None, "a"]
    together = features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(features(pa.array([t], pa.string()))[0], together[i], atol=1e-6)
    assert not together[1].any() and not together[5].any()
    assert np.allclose((together[[0, 2, 3, 4]] ** 2).sum(1), 1, atol=1e-4)


def test_words_are_features():
    one = features(pa.array(["alpha beta", "gamma beta", "beta alpha", "alpha", "ALPHA beta", "alpha"]))
    words = one[:, SHAPES:] > 0
    assert words.sum(1).tolist() == [3, 3, 3, 1, 3, 1]  # two words and their pair; one word and no pair
    assert (one[0, :SHAPES] == one[1, :SHAPES]).all()  # same shapes, told apart by words alone
    assert (words[0] & words[1]).sum() == 1 and (words[0] & words[2]).sum() == 2
    assert (words[0] == words[4]).all() and (words[3] == words[5]).all()
    many = pa.array(["alpha beta", "", "b " * 9] * FEATURE_ROWS)
    assert np.allclose(features(many)[-3:], features(many.slice(0, 3)), atol=1e-6)


def test_ratings(spark):
    rows = [(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 0, None), (6, 1, None), (7, None, 1), (None, 1, 0)]
    got = ratings(spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")).collect()
    assert [(r.doc_id, r.rating) for r in got] == [(1, 0), (2, 0), (3, 1), (4, 2), (5, 0), (6, None), (7, None), (None, 2)]


def test_whole_query_against_formula(spark):
    """The query's results from a fit and scores made row by row, without Spark."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    grades = {r.doc_id: 0 if r.quality == 0 else 2 - r.toxic for r in labels if r.doc_id in docs}
    assert set(grades.values()) == {0, 1, 2}
    train = sorted(k for k in grades if zlib.crc32(str(k).encode()) % 5)
    x = {k: features(pa.array([t], pa.string()))[0].astype(float) for k, t in docs.items()}
    model = fit(np.stack([x[k] for k in train]).astype(np.float16), np.array([grades[k] for k in train]))
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    rows = op4_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        above = [1 / (1 + np.exp(cut - x[r.doc_id] @ model.weights)) for cut in model.thresholds]
        assert r.tail_probability == pytest.approx(above[0], abs=0.02)
        assert r.expected_grade == pytest.approx(sum(above), abs=0.03)
        assert r.selected == (r.tail_probability >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id in grades]
    mean = [np.mean([r.expected_grade for r in held if grades[r.doc_id] == g]) for g in (0, 1, 2)]
    assert mean[0] < 0.7 < mean[1] < mean[2]


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_quality(docs, labels, ~held)
    again = fit_quality(docs.repartition(5), labels.repartition(3), ~held)
    assert np.allclose(model.weights, again.weights)
    out = grade(docs.selectExpr("*", "1 as selected"), model).join(labels, "doc_id").filter(held)
    assert out.columns.count("selected") == 1
    rows = out.select("quality", "selected", "expected_grade", "tail_probability").collect()
    kept = [r.selected for r in rows if r.quality == 1]
    gone = [not r.selected for r in rows if r.quality == 0]
    assert sum(kept) >= 0.97 * len(kept) and sum(gone) >= 0.8 * len(gone)
    assert all(r.expected_grade == pytest.approx(r.tail_probability) for r in rows)


def test_edges(spark, docs_of):
    model = CumulativeLink([0, 1], np.zeros(BUCKETS), np.array([-1.0]))
    docs = docs_of([None, "", "a", "a", "x " * 20000]).selectExpr("*", "text as expected_grade")
    rows = grade(docs, model).collect()
    assert len(rows) == 5 and {round(r.tail_probability, 6) for r in rows} == {0.731059}
    assert select_quality(docs, model).columns == docs.columns and select_quality(docs, model).count() == 5
    assert grade(docs_of([]), model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert fit_quality(docs, none, F.lit(True)).grades == [0]
    odd = spark.createDataFrame([(0, 1), (0, None), (None, 1), (2, 0), (2, 0), (3, 1)], "doc_id bigint, quality int")
    assert fit_quality(docs, odd, F.lit(True)).grades == [0, 1]
