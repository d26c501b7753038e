"""Balanced samples and exact train/dev/test splits, repeatable for a seed.

Membership follows the order of ``md5(seed:key)``, never ``rand()``, so it does
not depend on how the rows are partitioned. Each function runs a few counting
jobs to find the cut values (``hash_cuts``); the DataFrame it returns is then
only a filter or a ``CASE`` over the input, without sort, window or shuffle.
Give it a stored table rather than a long plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.constants import LABELS, SAMPLE_SIZE, SPLIT_SEED, TEST_FRACTION
from pairloom.functions.labels import rank_key
from pairloom.operators.keys import hash_cuts
from pairloom.operators.skew import salted_join
from pairloom.schemas import require_columns

BROADCAST_KEYS = 500_000  # 8-byte keys: 4 MB


def balanced_sample(
    df: DataFrame, n: int = SAMPLE_SIZE, key: str = "IDS", seed: int = SPLIT_SEED
) -> DataFrame:
    """``n // 2`` rows of each label, without replacement."""
    require_columns(df, "quality", key)
    half = n // 2

    def places(total: int) -> list[int]:
        if total < half:
            raise ValueError(f"a label has {total} rows, the sample needs {half}")
        return [half]

    labelled = df.filter(F.col("quality").isin(LABELS))
    cuts = hash_cuts(labelled, key, seed, places, group="quality")
    for label in LABELS:
        if label not in cuts and half > 0:
            raise ValueError(f"label {label} has no rows, the sample needs {half}")
    chosen = F.lit(False)
    for label, (cut,) in cuts.items():
        chosen = chosen | ((F.col("quality") == label) & (_rank(key, seed) <= cut))
    return labelled.filter(chosen)


def downsample_with_siblings(
    df: DataFrame,
    n: int = SAMPLE_SIZE,
    key: str = "IDS",
    seed: int = SPLIT_SEED,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """A balanced sample of the English rows, and the foreign rows of the same source.

    A table without ``lang`` counts as English. ``index`` names the source row. Up to
    ``broadcast_keys`` sampled sources are broadcast; more are joined with salted keys.
    """
    if "lang" not in df.columns:
        return balanced_sample(df, n, key, seed)
    require_columns(df, "index")
    sample = balanced_sample(df.filter(F.col("lang") == "en"), n, key, seed)
    foreign = df.filter(~F.col("lang").eqNullSafe("en"))
    sources = sample.select("index").distinct()
    if n <= broadcast_keys:  # the sample has n rows, no more
        siblings = foreign.join(F.broadcast(sources), "index", "left_semi")
    else:
        siblings = salted_join(foreign, sources, "index", key, "left_semi")
    return sample.unionByName(siblings)


def split_two(
    df: DataFrame,
    key: str = "IDS",
    fraction: float = TEST_FRACTION,
    seed: int = SPLIT_SEED,
    held_out: str = "dev",
    group_by: str | None = None,
) -> DataFrame:
    """Add ``split``: ``ceil(fraction * n)`` rows are held out, the rest train.

    With ``group_by`` the fraction is of the distinct values of that column, and
    rows that share one stay together; rows without one train.
    """
    require_columns(df, key, *([group_by] if group_by else []))
    unit = group_by or key
    units = df.select(unit).dropna().distinct() if group_by else df
    cuts = hash_cuts(units, unit, seed, lambda total: [math.ceil(fraction * total)])
    (cut,) = cuts.get(0, [""])
    held = F.coalesce(_rank(unit, seed) <= cut, F.lit(False))
    return df.withColumn("split", F.when(held, F.lit(held_out)).otherwise(F.lit("train")))


def split_in_sets(
    df: DataFrame,
    key: str = "IDS",
    fraction: float = TEST_FRACTION,
    seed: int = SPLIT_SEED,
    held_out: str = "dev",
) -> DataFrame:
    """``split_two`` within every set of ``lang_sets`` at once: adds ``members``.

    ``members`` is an array of (lang_set, split). The exact cuts of all sets come from the
    same counting passes (``hash_cuts`` by set over the keys alone), so their number does
    not depend on the number of sets.
    """
    require_columns(df, key, "lang_sets")
    units = df.select(key, F.explode("lang_sets").alias("_set"))
    cuts = hash_cuts(units, key, seed, lambda total: [math.ceil(fraction * total)], group="_set")
    known = F.create_map(*[F.lit(x) for name, (cut,) in cuts.items() for x in (name, cut)]) if cuts else None

    def member(name: Column) -> Column:
        held = F.coalesce(F.col("_rank") <= known[name], F.lit(False)) if cuts else F.lit(False)
        return F.struct(name.alias("lang_set"), F.when(held, F.lit(held_out)).otherwise(F.lit("train")).alias("split"))

    ranked = df.withColumn("_rank", _rank(key, seed))
    return ranked.withColumn("members", F.transform("lang_sets", member)).drop("_rank", "lang_sets")


def split_three(
    df: DataFrame, key: str = "IDS", fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED
) -> DataFrame:
    """Add ``split``: test and dev of ``ceil(fraction * n)`` rows each, then train."""
    require_columns(df, key)

    def places(total: int) -> list[int]:
        size = math.ceil(fraction * total)
        return [size, min(2 * size, total)]

    test, dev = hash_cuts(df, key, seed, places).get(0, ["", ""])
    rank = _rank(key, seed)
    return df.withColumn(
        "split",
        F.when(rank <= test, F.lit("test")).when(rank <= dev, F.lit("dev")).otherwise(F.lit("train")),
    )


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def _rank(key: str, seed: int) -> Column:
    return rank_key(F.col(key), seed)
