"""Run grids, language sets, the leaderboard and the language-family roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.constants import (
    DATASETS,
    GRID_LANGUAGE_SETS,
    LANGUAGE_FAMILIES,
    LANGUAGES,
    METRICS,
    MODELS,
)
from pairloom.operators.metrics import with_metrics


def language_sets(languages: list[str] = LANGUAGES) -> dict[str, list[str]]:
    """``L`` is English and ``L``, ``all`` is every language."""
    sets = {code: sorted({"en", code}) for code in languages}
    return {**sets, "all": list(languages)}


def language_set_table(spark: SparkSession, languages: list[str] = LANGUAGES) -> DataFrame:
    """``lang_set, lang``: a few dozen rows, fixed by the list of languages."""
    rows = [(name, code) for name, codes in language_sets(languages).items() for code in codes]
    return spark.createDataFrame(rows, "lang_set string, lang string")


def run_grid(
    spark: SparkSession,
    datasets: list[str] = DATASETS,
    models: list[str] = MODELS,
    lang_sets: list[str] = GRID_LANGUAGE_SETS,
) -> DataFrame:
    """One row for each dataset, model and language set."""
    axes = {"dataset": datasets, "model": models, "lang_set": lang_sets}
    grid = spark.range(1).drop("id")
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def expand_to_sets(df: DataFrame, sets: DataFrame) -> DataFrame:
    """Each row once for each language set that holds its language.

    Aggregate first where the result allows it: a row is repeated once per set.
    """
    return df.join(F.broadcast(sets), "lang")


def grid_sizes(pairs: DataFrame, grid: DataFrame, sets: DataFrame) -> DataFrame:
    """Training rows and positives of every run.

    The pairs are counted per language first, so only those few counts are
    expanded to the sets and the runs.
    """
    per_lang = pairs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("quality").cast("bigint")).alias("pos")
    )
    per_set = (
        expand_to_sets(per_lang, sets)
        .groupBy("lang_set")
        .agg(F.sum("n").alias("n_rows"), F.sum("pos").alias("n_positive"))
    )
    return grid.join(F.broadcast(per_set), "lang_set", "left").select(
        "dataset",
        "model",
        "lang_set",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_positive", F.lit(0)).alias("n_positive"),
    )


def leaderboard(
    results: DataFrame,
    metrics: list[str] = METRICS,
    baseline: str = "baseline",
    everything: str = "all",
) -> DataFrame:
    """Per dataset and model: the baseline, the ``all`` run and the best language.

    The best language has the highest accuracy, the first code on ties. Each
    metric gets a ``<name>_up`` flag: is it above the baseline's? The results are
    read once; a window holds the runs of one model, one per language set.
    """
    single = ~F.col("langs").isin(baseline, everything)
    kind = (
        F.when(F.col("langs") == baseline, "baseline")
        .when(F.col("langs") == everything, "all")
        .otherwise("best")
    )
    runs = Window.partitionBy("dataset", "model")
    order = Window.partitionBy("dataset", "model", single).orderBy(F.desc("accuracy"), "langs")

    def is_up(metric: str) -> Column:
        value = F.col(f"`{metric}`")
        base = F.max(F.when(F.col("langs") == baseline, value)).over(runs)
        return F.coalesce(value > base, F.lit(False)).alias(f"{metric}_up")

    ranked = results.select(
        "dataset",
        "model",
        kind.alias("kind"),
        "langs",
        *[F.col(f"`{m}`") for m in metrics],
        *[is_up(m) for m in metrics],
        F.row_number().over(order).alias("_rank"),
    )
    return ranked.filter((F.col("kind") != "best") | (F.col("_rank") == 1)).drop("_rank")


def family_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        LANGUAGE_FAMILIES, "lang string, language string, family string, branch string"
    )


def family_rollup(pairs: DataFrame, families: DataFrame) -> DataFrame:
    """Rows and positives per family and language, with sub-totals and the total.

    Counted per language first; only those counts meet the family table. A
    language it lacks goes to the family ``other``.
    """
    per_lang = pairs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("quality").cast("bigint")).alias("pos")
    )
    named = per_lang.join(F.broadcast(families), "lang", "left").withColumn(
        "family", F.coalesce("family", F.lit("other"))
    )
    return (
        named.rollup("family", "lang")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("pos").alias("n_positive"),
            F.grouping_id().cast("int").alias("level"),
        )
        .select("family", "lang", "n_rows", "n_positive", "level")
    )


def family_metrics(counts: DataFrame, families: DataFrame, *by: str) -> DataFrame:
    """The metrics of every run by family, branch and language, with sub-totals and the total.

    ``counts`` has the four confusion counts for each ``lang`` and the columns ``by``. They
    are added up over grouping sets, and the metrics follow from the sums, so predictions
    are counted once for all levels. ``level`` is 0 for a language, 1 for a branch, 3 for a family and 7
    for the total. Languages without a family go to the family and branch ``other``.
    """
    named = counts.join(F.broadcast(families), "lang", "left").withColumns(
        {
            "family": F.coalesce("family", F.lit("other")),
            "branch": F.coalesce("branch", F.lit("other")),
            "language": F.coalesce("language", "lang"),
        }
    )
    levels = ["family", "branch", "language"]
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    sets = [[*by, *levels[:n]] for n in range(len(levels) + 1)]
    level = F.grouping_id().cast("int").alias("level")
    rolled = named.groupingSets([[F.col(c) for c in s] for s in sets], *by, *levels).agg(*sums, level)
    return with_metrics(rolled).drop("tp", "fp", "fn", "tn")
