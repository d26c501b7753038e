"""Iterative fits: the same rows give the same states, however they are cut or interrupted."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.labels import cross_entropy
from pairloom.operators.batches import evaluation_loss
from pairloom.plans import training
from pairloom.shared import committed_parts, fresh_path, write_table

ROWS = "IDS bigint, quality int, features array<struct<feature:int,value:double>>"
ARGS = {"n_features": 4, "epochs": 4, "batches": 3, "rate": 2.0, "warmup": 2}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(400):
        x = [rng.gauss(0, 1), rng.gauss(0, 1)]
        label = int(x[0] - 2 * x[1] + rng.gauss(0, 0.5) > 0.3)
        out.append((i, label, [(0, 1.0), (1, x[0]), (2, x[1])][: 3 if i % 5 else 2]))
    table = write_table(spark.createDataFrame(out, ROWS), "rows")
    return table.filter("IDS % 4 <> 0"), table.filter("IDS % 4 = 0"), out


def state(spark, path, step):
    found = {r.feature: r.weight for r in training.read_state(spark, path, step).collect()}
    return np.array([found[i] for i in range(4)])


def test_against_numpy(spark, rows):
    train, dev, raw = rows
    path = fresh_path(spark, "fit")
    reports = training.fit_epochs(train, dev, path, **ARGS).orderBy("step").collect()
    assert [(r.step, r.epoch) for r in reports] == [(3, 1), (6, 2), (9, 3), (12, 4)]
    x = np.zeros((len(raw), 4))
    for i, (_, _, fs) in enumerate(raw):
        for f, v in fs:
            x[i, f] = v
    y = np.array([r[1] for r in raw])
    dealt = {
        e: np.array([r.b for r in spark.range(len(raw)).select("id", training.batch_of("id", e, 3).alias("b")).orderBy("id").collect()])
        for e in range(4)
    }
    w = np.zeros(4)
    for step in range(12):
        own = (np.arange(len(raw)) % 4 != 0) & (dealt[step // 3] == step % 3)
        error = 1 / (1 + np.exp(-x[own] @ w)) - y[own]
        w = w - training.rate_at(step, 12, 2.0, 2) * (x[own] * error[:, None]).mean(0)
    assert np.abs(w - state(spark, path, 12)).max() < 1e-9
    held = np.arange(len(raw)) % 4 == 0
    m = x[held] @ w
    assert math.isclose(reports[-1].dev_loss, np.mean(np.logaddexp(0, m) - y[held] * m), abs_tol=1e-9)
    assert math.isclose(reports[-1].accuracy, np.mean((m > 0) == y[held]), abs_tol=1e-9)
    assert reports[-1].accuracy > 0.8


def test_partitions_and_interruption(spark, rows):
    train, dev, _ = rows
    whole, one, resumed = (fresh_path(spark, n) for n in ("whole", "one", "resumed"))
    reports = training.fit_epochs(train.repartition(8), dev, whole, **ARGS).orderBy("step").collect()
    training.fit_epochs(train.coalesce(1), dev, one, **ARGS)
    assert np.abs(state(spark, whole, 12) - state(spark, one, 12)).max() < 1e-9

    class Stop(Exception):
        pass

    stored = training._store

    def failing(df, folder, step):
        if step == 7:
            df.write.mode("overwrite").parquet(f"{folder}/_broken/step={step}")
            raise Stop
        stored(df, folder, step)

    training._store = failing
    try:
        with pytest.raises(Stop):
            training.fit_epochs(train.repartition(8), dev, resumed, **ARGS)
    finally:
        training._store = stored
    assert max(committed_parts(spark, f"{resumed}/states", "step")) == 6
    again = training.fit_epochs(train.repartition(8), dev, resumed, **ARGS).orderBy("step").collect()
    assert np.abs(state(spark, whole, 12) - state(spark, resumed, 12)).max() < 1e-9
    assert [(r.step, round(r.dev_loss, 9)) for r in again] == [(r.step, round(r.dev_loss, 9)) for r in reports]


def test_intervals_and_best_state(spark, rows):
    train, dev, _ = rows
    path = fresh_path(spark, "fit")
    reports = training.fit_epochs(train, dev, path, 4, epochs=2, batches=4, rate=2.0, every=3)
    assert [r.step for r in reports.orderBy("step").collect()] == [3, 6, 8]
    step = training.best_step(reports, "accuracy")
    top = reports.agg(F.max("accuracy")).first()[0]
    assert step == reports.filter(F.col("accuracy") == top).agg(F.min("step")).first()[0]
    best = {r.feature: r.weight for r in training.best_state(spark, path, "accuracy").collect()}
    assert best == {i: w for i, w in enumerate(state(spark, path, step).tolist())}


def test_best_step_takes_the_first_of_equal_ones(spark):
    reports = spark.createDataFrame([(5, 0.5), (2, 0.7), (4, 0.7), (6, None)], "step int, f1_score double")
    assert training.best_step(reports) == 2


def test_loss_of_large_logits(spark):
    rows = [([1000.0, -1000.0], 0), ([1000.0, -1000.0], 1), ([-1000.0, -1000.0], 1), ([1e308, 1e308], 0), ([0.0, 0.0], None), ([1.0], 1)]
    df = spark.createDataFrame(rows, "logits array<double>, quality int")
    got = [r[0] for r in df.select(cross_entropy(F.col("logits"), F.col("quality"))).collect()]
    assert got[:2] == [0.0, 2000.0] and math.isclose(got[2], math.log(2)) and got[4:] == [None, None]
    assert got[3] >= 0


def test_loss_is_the_mean_of_batch_means(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 3), rng.gauss(0, 3)], i % 2) for i in range(70)]
    df = spark.createDataFrame(rows, "IDS bigint, logits array<double>, quality int").repartition(4)
    loss = [np.logaddexp(*x) - x[y] for _, x, y in rows]
    want = np.mean([np.mean(loss[i : i + 32]) for i in (0, 32, 64)])
    got = evaluation_loss(df).first()
    assert math.isclose(got.eval_loss, want) and got.n_batches == 3
    with pytest.raises(Exception, match="no logit"):
        evaluation_loss(df.withColumn("quality", F.lit(2))).collect()
