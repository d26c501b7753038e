"""Whole experiments: every model on every language set, scored in one aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.grid import leaderboard, language_sets
from pairloom.constants import METRICS
from pairloom.operators.metrics import (
    confusion,
    evaluate_runs,
    metric_report,
    refuse_invalid,
    result_records,
    with_metrics,
)
from pairloom.plans.prepare import Source, prepare
from pairloom.shared import fresh_path, release_shuffles, scratch, write_table
from pairloom.sources.writers import append_records

Corpus = Callable[[list[str] | None], DataFrame]
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def evaluate(
    preds: DataFrame,
    gold: DataFrame,
    config: dict[str, str],
    records_path: str | None = None,
    unmatched: str = "raise",
) -> DataFrame:
    """The metric report of one run; its record is appended when a path is given.

    ``preds`` has ``IDS, pred`` and ``gold`` has ``IDS, quality``. A prediction
    without label, a label without prediction, and a value that is not 0 or 1 fail
    the job. With ``unmatched="count"`` they are left out of the metrics and reported
    as ``n_only_pred``, ``n_only_gold`` and ``n_invalid``.
    """
    if unmatched not in ("raise", "count"):
        raise ValueError(f"unmatched={unmatched!r}")
    both = (
        preds.select("IDS", "pred", F.lit(1).alias("_p"))
        .join(gold.select("IDS", "quality", F.lit(1).alias("_g")), "IDS", "full_outer")
        .withColumns({name: F.lit(config[name]) for name in ("dataset", "model", "langs")})
    )
    only = {
        "n_only_pred": F.count(F.when(F.col("_g").isNull(), 1)),
        "n_only_gold": F.count(F.when(F.col("_p").isNull(), 1)),
    }
    run = ("dataset", "model", "langs")
    counts = confusion(both, *run, gold="quality", also=tuple(c.alias(n) for n, c in only.items()))
    if unmatched == "raise":
        counts = refuse_invalid(counts)
    counts = counts.withColumn("n_invalid", F.col("n_invalid") - F.col("n_only_pred") - F.col("n_only_gold"))
    results = write_table(with_metrics(counts).drop("tp", "fp", "fn", "tn"), "results")
    if records_path:
        append_records(result_records(results), records_path)
    extra = ["n_only_pred", "n_only_gold", "n_invalid"] if unmatched == "count" else []
    return metric_report(results, *run, metrics=[*METRICS, *extra])


def prepared(spark: SparkSession, dataset: str, sources: dict[str, Source], downsample: bool = False) -> Corpus:
    """A corpus of ``experiment``: ``prepare`` run anew for each language set.

    ``sources`` holds those of the baseline and of the augmented corpus; each mode
    takes its own. ``downsample`` is for the modes that sample (see ``prepare``).
    """

    def corpus(langs: list[str] | None) -> DataFrame:
        mode = "augmented" if langs else "baseline"
        path = fresh_path(spark, f"{dataset}-{mode}")
        sampled = downsample and (mode == "baseline" or dataset == "mrpc")
        prepare(spark, dataset, mode, sources, path, langs, sampled)
        return spark.read.parquet(path)

    return corpus


def experiment(
    corpora: dict[str, Corpus],
    models: dict[str, Fit],
    lang_sets: list[str],
    records_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results per run and the leaderboard, for every dataset, model and language set.

    ``corpora`` maps a dataset to a function from language codes (none for the baseline) to
    its stored splits: for each set the pairs are numbered, filtered by language, freed
    from duplicates, sampled and split before anything is fitted (``prepared``).
    ``models`` maps a name to ``fit(train) -> predict``, where ``predict(test)`` adds
    ``pred``. The runs of a corpus meet in one aggregate, whose few rows are stored, so that no
    model runs again for the leaderboard, and what was written to fresh paths (``shared.fresh_path``) for the
    corpus and its models is deleted before the next one is made.
    """
    sets = {"baseline": None, **{name: language_sets()[name] for name in lang_sets}}
    spark, path, of_runs = SparkSession.active(), fresh_path(SparkSession.active(), "runs"), None
    for dataset, corpus in corpora.items():
        for name, codes in sets.items():
            with scratch(spark):
                stored = corpus(codes)
                train, test = (stored.filter(F.col("split") == s) for s in ("train", "test"))
                runs = None
                for model, fit in models.items():
                    predicted = fit(train)(test).select(
                        F.lit(dataset).alias("dataset"),
                        F.lit(model).alias("model"),
                        F.lit(name).alias("langs"),
                        "quality",
                        "pred",
                    )
                    runs = predicted if runs is None else runs.unionByName(predicted)
                found = evaluate_runs(runs, "dataset", "model", "langs", gold="quality")
                found.coalesce(1).write.mode("append").parquet(path)
                of_runs = found.schema
            release_shuffles(spark)
    results = write_table(spark.read.schema(of_runs).parquet(path).coalesce(1), "results")
    if records_path:
        append_records(result_records(results), records_path)
    return results, leaderboard(results)
