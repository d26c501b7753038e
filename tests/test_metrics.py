from __future__ import annotations

import random

import pytest

from pairloom.constants import METRICS
from pairloom.operators import grid, metrics
from pairloom.plans.experiment import evaluate


def metrics_of(spark, gold, pred):
    df = spark.createDataFrame(list(zip(gold, pred)), "gold int, pred int")
    return metrics.evaluate_runs(df).first().asDict()


def brute(gold, pred):
    n = len(gold)

    def f1(cls):
        tp = sum(g == cls == p for g, p in zip(gold, pred))
        den = sum(g == cls for g in gold) + sum(p == cls for p in pred)
        return 2 * tp / den if den else 0.0

    def share(cls, of):
        hits = [g == p for g, p, o in zip(gold, pred, of) if o == cls]
        return sum(hits) / len(hits) if hits else 0.0

    present = sorted(set(gold) | set(pred))
    return {
        "accuracy": sum(g == p for g, p in zip(gold, pred)) / n,
        "macro_f1_score": sum(map(f1, present)) / len(present),
        "weighted_f1_score": sum(f1(c) * gold.count(c) for c in (0, 1)) / n,
        "f1_score": f1(1),
        "precision_score": share(1, pred),
        "recall_score": share(1, gold),
        "ROC-AUC": (share(1, gold) + share(0, gold)) / 2 if len(set(gold)) == 2 else None,
    }


@pytest.mark.parametrize(
    "gold,pred",
    [([1, 1, 0], [0, 0, 0]), ([1, 1], [1, 0]), ([0, 0], [0, 0]), ([0, 0], [1, 1]), ([1, 0, 1, 0], [1, 1, 0, 0])],
)
def test_edges(spark, gold, pred):
    assert metrics_of(spark, gold, pred) == pytest.approx(brute(gold, pred))


def test_many_runs_at_once(spark):
    rng = random.Random(7)
    rows = [(f"r{rng.randrange(6)}", rng.randrange(2), rng.randrange(2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "run string, gold int, pred int")
    for r in metrics.evaluate_runs(df, "run").collect():
        gold = [g for run, g, _ in rows if run == r.run]
        pred = [p for run, _, p in rows if run == r.run]
        found = {m: r[m] for m in METRICS}
        assert found == pytest.approx(brute(gold, pred))


def test_alignment_counts(spark):
    preds = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "IDS int, pred int")
    gold = spark.createDataFrame([(2, 1), (3, 0), (4, 0), (5, 1)], "IDS int, quality int")
    assert tuple(metrics.unmatched(preds, gold).first()) == (2, 1, 2)


def test_report_and_records(spark, tmp_path):
    preds = spark.createDataFrame([(1, 1), (2, 1)], "IDS int, pred int")
    gold = spark.createDataFrame([(1, 1), (2, 1)], "IDS int, quality int")
    path = str(tmp_path / "records")
    config = {"dataset": "mrpc", "model": "bert", "langs": "es"}
    for _ in range(2):
        report = evaluate(preds, gold, config, path).collect()
    assert [r.key for r in report] == sorted(METRICS)
    lines = {r.key: (r.line, r.table_line) for r in report}
    assert lines["accuracy"] == ("accuracy = 1.0", "            accuracy: 1.000000")
    assert lines["ROC-AUC"] == ("ROC-AUC = nan", "             ROC-AUC: nan")
    stored = spark.read.json(path)
    assert stored.count() == 2 and stored.filter("dataset = 'mrpc'").first().config.langs == "es"


def test_leaderboard(spark):
    # Accuracy, F1, precision and recall of twelve published runs.
    runs = [
        ("bert", "baseline", 0.802, 0.858, 0.820, 0.899),
        ("bert", "all", 0.824, 0.877, 0.819, 0.945),
        ("bert", "es", 0.835, 0.882, 0.840, 0.929),
        ("xlnet", "baseline", 0.845, 0.886, 0.868, 0.905),
        ("xlnet", "all", 0.837, 0.883, 0.840, 0.932),
        ("xlnet", "ja", 0.860, 0.897, 0.877, 0.919),
        ("roberta", "baseline", 0.874, 0.906, 0.898, 0.914),
        ("roberta", "all", 0.872, 0.907, 0.877, 0.939),
        ("roberta", "vi", 0.886, 0.915, 0.906, 0.925),
        ("albert", "baseline", 0.853, 0.890, 0.885, 0.895),
        ("albert", "all", 0.841, 0.886, 0.847, 0.929),
        ("albert", "yo", 0.867, 0.902, 0.884, 0.922),
    ]
    names = ["accuracy", "f1_score", "precision_score", "recall_score"]
    worse = [(m, "ko", 0.1, 0.1, 0.1, 0.1) for m in ("bert", "xlnet", "roberta", "albert")]
    df = spark.createDataFrame([("d", *r) for r in runs + worse], ["dataset", "model", "langs", *names])
    board = grid.leaderboard(df, metrics=names).collect()
    up = {(r.model, r.kind, r.langs): "".join("x" if r[f"{m}_up"] else "." for m in names) for r in board}
    assert up == {
        ("bert", "baseline", "baseline"): "....",
        ("bert", "all", "all"): "xx.x",
        ("bert", "best", "es"): "xxxx",
        ("xlnet", "baseline", "baseline"): "....",
        ("xlnet", "all", "all"): "...x",
        ("xlnet", "best", "ja"): "xxxx",
        ("roberta", "baseline", "baseline"): "....",
        ("roberta", "all", "all"): ".x.x",
        ("roberta", "best", "vi"): "xxxx",
        ("albert", "baseline", "baseline"): "....",
        ("albert", "all", "all"): "...x",
        ("albert", "best", "yo"): "xx.x",
    }


def test_grid(spark):
    runs = grid.run_grid(spark)
    assert runs.count() == 132 and runs.distinct().count() == 132
    sets = {}
    for r in grid.language_set_table(spark).collect():
        sets.setdefault(r.lang_set, set()).add(r.lang)
    assert sets["en"] == {"en"} and sets["ko"] == {"en", "ko"} and len(sets["all"]) == 11


def test_invalid_labels_fail_or_count(spark):
    rows = [("m", 1, 1), ("m", 0, None), ("m", None, 0), ("m", 1, 2), ("n", 0, 0)]
    df = spark.createDataFrame(rows, "model string, gold int, pred int")
    with pytest.raises(Exception, match="3 rows"):
        metrics.evaluate_runs(df, "model").collect()
    found = {r.model: (r.n_invalid, r.accuracy) for r in metrics.evaluate_runs(df, "model", invalid="count").collect()}
    assert found == {"m": (3, 1.0), "n": (0, 1.0)}
    with pytest.raises(ValueError):
        metrics.evaluate_runs(df, invalid="drop")
