"""The whole run grid: every language set prepared, fitted and scored together.

``plans.experiment`` prepares one corpus after another. Here the sets are data: a row is
stored once with the sets and splits it belongs to, and every step handles all sets at
once. The number of jobs depends on datasets and models, and not on the language sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.constants import GRID_LANGUAGE_SETS
from pairloom.operators.dedup import remove_duplicates_in_sets
from pairloom.operators.grid import language_sets, leaderboard
from pairloom.operators.metrics import evaluate_runs, result_records
from pairloom.operators.normalize import normalize_mrpc
from pairloom.operators.sampling import downsample_with_siblings, split_in_sets
from pairloom.plans.prepare import BASELINES, Source, csv_file, mrpc_file, twitter_file
from pairloom.shared import release_shuffles, write_table
from pairloom.sources.writers import append_records

#: ``fit(train) -> predict``: both tables have ``lang_set``; ``predict(test)`` adds ``pred``.
GridFit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]

BASELINE = "baseline"
_PAIR = ("IDS", "sentence", "paraphrase", "quality")


def _members(names: list[str], split: Column | str) -> Column:
    split = F.lit(split) if isinstance(split, str) else split
    return F.array(*[F.struct(F.lit(n).alias("lang_set"), split.alias("split")) for n in names])


def _splits(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]).alias("splits")


def _train(dataset: str, pairs: DataFrame, sets: dict[str, list[str]], downsample: bool) -> DataFrame:
    if dataset == "mrpc" and downsample:
        # English rows all stay, and are the same in every set: one sample of them serves all sets, and is drawn
        # before the duplicates are removed, so that the rows which the sample leaves out are not moved or stored.
        sample = write_table(downsample_with_siblings(pairs), "grid-sample")
        return split_in_sets(write_table(remove_duplicates_in_sets(pairs, sets, part=sample), "grid-clean"))
    clean = write_table(remove_duplicates_in_sets(pairs, sets), "grid-clean")
    if dataset != "mrpc":
        train = lambda name: F.struct(name.alias("lang_set"), F.lit("train").alias("split"))
        return clean.withColumn("members", F.transform("lang_sets", train))
    return split_in_sets(clean)


def prepare_grid(
    spark: SparkSession,
    dataset: str,
    sources: dict[str, Source],
    lang_sets: list[str] = GRID_LANGUAGE_SETS,
    downsample: bool = False,
    made: dict | None = None,
) -> DataFrame:
    """The baseline and all language sets of a dataset as one table.

    Rows ``IDS, sentence, paraphrase, quality, members, splits``, where ``members`` lists the
    (lang_set, split) that a row belongs to and ``splits`` those that rows of its part may belong to; the result of ``prepare`` for a set is
    ``of_split(table, split)`` with that ``lang_set``. ``sources`` holds those of the baseline and of
    the augmented corpus, as for ``prepare``. Every set holds English. Training rows are stored; the others are
    too unless all sources are tables, which are read where they are. ``made`` keeps the training rows
    for the next dataset with the same augmented corpus.
    """
    if dataset not in BASELINES:
        raise ValueError(f"no corpus {dataset!r}")
    sets = {name: language_sets()[name] for name in lang_sets}
    if any("en" not in codes for codes in sets.values()):
        raise ValueError("every language set holds English")
    names = list(sets)
    layout = schemas.RAW_MRPC_AUGMENTED if dataset == "mrpc" else schemas.AUGMENTED
    augmented = csv_file(spark, sources["augmented"], layout)
    augmented = normalize_mrpc(augmented) if dataset == "mrpc" else augmented
    if not isinstance(sources["augmented"], DataFrame):  # a table is read where it is, a parsed file is stored
        augmented = write_table(augmented, "grid-augmented")
    baseline = BASELINES[dataset](spark, sources, None, downsample)
    source = sources["augmented"]
    of_sets = (dataset == "mrpc" and downsample, dataset == "mrpc", id(source) if isinstance(source, DataFrame) else source, *names)
    made = {} if made is None else made
    if of_sets not in made:
        splits = ["train", "dev"] if dataset == "mrpc" else ["train"]
        made[of_sets] = _train(dataset, augmented, sets, downsample).select(*_PAIR, "members", _splits(*splits))
    parts = [baseline.select("*", _members([BASELINE], F.col("split")).alias("members"), _splits("train", "dev", "test"))]
    if dataset != "mrpc":
        dev = csv_file(spark, sources["dev"], schemas.AUGMENTED)
        parts.append(dev.select("*", _members(names, "dev").alias("members"), _splits("dev")))
    readers = {"mrpc": mrpc_file, "tpc": twitter_file}
    read = readers.get(dataset, lambda s, source: csv_file(s, source, schemas.AUGMENTED))
    parts.append(read(spark, sources["test"]).select("*", _members(names, "test").alias("members"), _splits("test")))
    whole = parts[0].select(*_PAIR, "members", "splits")
    for part in parts[1:]:
        whole = whole.unionByName(part.select(*_PAIR, "members", "splits"))
    if not all(isinstance(own, DataFrame) for own in sources.values()):
        whole = write_table(whole, f"grid-{dataset}")
    release_shuffles(spark)
    return made[of_sets].unionByName(whole)


def of_split(table: DataFrame, split: str) -> DataFrame:
    """The rows of one split, once for each set that has them there, with ``lang_set``."""
    if "splits" in table.columns:  # the same in all rows of a part, so that other parts are not read
        table = table.filter(F.array_contains("splits", split))
    own = table.select(*_PAIR, F.explode("members").alias("_member"))
    return own.filter(F.col("_member.split") == split).select(*_PAIR, F.col("_member.lang_set").alias("lang_set"))


def experiment_grid(
    spark: SparkSession,
    corpora: dict[str, dict[str, Source]],
    models: dict[str, GridFit],
    lang_sets: list[str] = GRID_LANGUAGE_SETS,
    records_path: str | None = None,
    downsample: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Results per run and the leaderboard, for every dataset, model and language set.

    ``corpora`` maps a dataset to its sources; ``downsample`` names the datasets to be
    sampled. A model is fitted on the training rows of all sets together, told apart by
    ``lang_set``, and predicts the test rows of all sets together. All runs meet in one
    aggregate, whose few rows are stored.
    """
    runs, made = None, {}
    for dataset, sources in corpora.items():
        table = prepare_grid(spark, dataset, sources, lang_sets, dataset in downsample, made)
        train, test = of_split(table, "train"), of_split(table, "test")
        for model, fit in models.items():
            predicted = fit(train)(test).select(
                F.lit(dataset).alias("dataset"),
                F.lit(model).alias("model"),
                F.col("lang_set").alias("langs"),
                "quality",
                "pred",
            )
            runs = predicted if runs is None else runs.unionByName(predicted)
    results = write_table(evaluate_runs(runs, "dataset", "model", "langs", gold="quality"), "results")
    if records_path:
        append_records(result_records(results), records_path)
    return results, leaderboard(results)
