"""Corpora from their raw files to stored train, dev and test splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import schemas
from pairloom.constants import TARGET_LANGUAGES
from pairloom.operators.augment import Translation, tag_english
from pairloom.operators.dedup import remove_duplicates
from pairloom.operators.keys import row_index
from pairloom.operators.normalize import (
    filter_languages,
    normalize_mrpc,
    normalize_quora,
    normalize_twitter,
)
from pairloom.operators.sampling import (
    balanced_sample,
    downsample_with_siblings,
    split_three,
    split_two,
)
from pairloom.shared import CODEC, fresh_path, release_shuffles, scratch, write_table
from pairloom.sources.readers import read_csv_pairs, read_tsv_pairs, read_tsv_quoted
from pairloom.sources.writers import write_splits


@dataclass(frozen=True)
class RawFile:
    """A path in the raw layout with what its readers need to know.

    ``multi_line`` says how files with line ends inside fields are scanned (``read_tsv_quoted``);
    ``na_words=False`` keeps cell texts such as "NA" as they are.
    """

    path: str
    multi_line: bool | str | None = None
    na_words: bool = True


Source = str | RawFile | DataFrame


def prepare(
    spark: SparkSession,
    dataset: str,
    mode: str,
    sources: dict[str, Source],
    out: str,
    langs: list[str] | None = None,
    downsample: bool = False,
    fmt: str = "parquet",
) -> dict[str, int]:
    """Build a corpus, store it by split at ``out`` and return the split sizes.

    ``mode`` is ``baseline`` (raw English files) or ``augmented`` (a file with
    all languages, of which ``langs`` are kept). ``sources`` names the files:
    ``train`` and ``test`` for a baseline (Quora: ``all``), ``augmented`` and
    ``test`` for an augmented corpus, there with ``dev`` but for MRPC. A source
    may be a path in the raw layout, a ``RawFile`` with reader options, or a DataFrame
    that already has its columns.
    """
    builders = {
        ("mrpc", "baseline"): _mrpc_baseline,
        ("mrpc", "augmented"): _mrpc_augmented,
        ("tpc", "baseline"): _twitter_baseline,
        ("tpc", "augmented"): _twitter_augmented,
        ("quora", "baseline"): _quora_baseline,
        ("quora", "augmented"): _quora_augmented,
    }
    if (dataset, mode) not in builders:
        raise ValueError(f"no corpus {dataset!r} in mode {mode!r}")
    if (mode == "augmented") != bool(langs):
        raise ValueError("languages go with the augmented mode, and only with it")
    if downsample and (dataset, mode) in (("tpc", "augmented"), ("quora", "augmented")):
        raise ValueError("this corpus is sampled before it is augmented")
    splits = builders[dataset, mode](spark, sources, langs, downsample)
    return write_splits(splits, out, fmt)


def _stack(**parts: DataFrame) -> DataFrame:
    """Put tables under one another, tagged with the split they are."""
    whole = None
    for name, part in parts.items():
        tagged = part if "split" in part.columns else part.withColumn("split", F.lit(name))
        whole = tagged if whole is None else whole.unionByName(tagged, allowMissingColumns=True)
    return whole


def _raw(source: Source) -> RawFile | None:
    return RawFile(source) if isinstance(source, str) else source if isinstance(source, RawFile) else None


def mrpc_file(spark: SparkSession, source: Source) -> DataFrame:
    file = _raw(source)
    return read_tsv_pairs(spark, file.path) if file else source


def twitter_file(spark: SparkSession, source: Source) -> DataFrame:
    file = _raw(source)
    raw = read_tsv_quoted(spark, file.path, multi_line=file.multi_line) if file else source
    return normalize_twitter(raw)


def csv_file(spark: SparkSession, source: Source, schema: T.StructType) -> DataFrame:
    file = _raw(source)
    if not file:
        return source
    renumber = "IDS" in schema.names
    return read_csv_pairs(spark, file.path, schema, renumber, file.na_words, file.multi_line)


def _augmented_train(pairs: DataFrame, langs: list[str]) -> DataFrame:
    """The language filter comes after the numbering and before the duplicates."""
    return remove_duplicates(filter_languages(pairs, langs))


def _mrpc_baseline(spark, sources, langs, downsample) -> DataFrame:
    pairs = mrpc_file(spark, sources["train"])
    if downsample:
        pairs = balanced_sample(pairs if isinstance(sources["train"], DataFrame) else write_table(pairs, "mrpc"))
    return _stack(
        train=split_two(write_table(pairs, "mrpc-train")), test=mrpc_file(spark, sources["test"])
    )


def _mrpc_augmented(spark, sources, langs, downsample) -> DataFrame:
    raw = csv_file(spark, sources["augmented"], schemas.RAW_MRPC_AUGMENTED)
    pairs = write_table(_augmented_train(normalize_mrpc(raw), langs), "mrpc-clean")
    if downsample:
        pairs = write_table(downsample_with_siblings(pairs), "mrpc-sample")
    return _stack(train=split_two(pairs), test=mrpc_file(spark, sources["test"]))


def _twitter_baseline(spark, sources, langs, downsample) -> DataFrame:
    pairs = write_table(twitter_file(spark, sources["train"]), "tpc-clean")
    if downsample:
        pairs = write_table(balanced_sample(pairs), "tpc-sample")
    return _stack(train=split_two(pairs), test=twitter_file(spark, sources["test"]))


def _twitter_augmented(spark, sources, langs, downsample) -> DataFrame:
    pairs = csv_file(spark, sources["augmented"], schemas.AUGMENTED)
    return _stack(
        train=_augmented_train(pairs, langs),
        dev=csv_file(spark, sources["dev"], schemas.AUGMENTED),
        test=twitter_file(spark, sources["test"]),
    )


def _quora_baseline(spark, sources, langs, downsample) -> DataFrame:
    raw = csv_file(spark, sources["all"], schemas.RAW_QUORA)
    pairs = write_table(normalize_quora(raw), "quora-clean")
    if not downsample:
        return split_three(pairs)
    halves = split_two(pairs, held_out="test")
    rest = halves.filter(F.col("split") == "train").drop("split")
    sample = write_table(balanced_sample(rest), "quora-sample")
    return _stack(train=split_two(sample), test=halves.filter(F.col("split") == "test"))


def _quora_augmented(spark, sources, langs, downsample) -> DataFrame:
    pairs = csv_file(spark, sources["augmented"], schemas.AUGMENTED)
    return _stack(
        train=_augmented_train(pairs, langs),
        dev=csv_file(spark, sources["dev"], schemas.AUGMENTED),
        test=csv_file(spark, sources["test"], schemas.AUGMENTED),
    )


BASELINES = {"mrpc": _mrpc_baseline, "tpc": _twitter_baseline, "quora": _quora_baseline}


def augment_numbered(pairs: DataFrame, translate: Translation, langs: list[str] = TARGET_LANGUAGES) -> DataFrame:
    """``renumber_augmented`` of ``augment_by_column``, with the English rows alone sorted.

    Every row is there in every language, so its number follows from its place among the
    English rows. Only these are stored; the copies are a narrow explode whenever they are read.
    """
    english = row_index(tag_english(pairs).drop("lang"), "IDS", name="_at")
    n = english.count()
    codes = F.array(*[F.lit(c) for c in ["en", *langs]])
    copies = english.select("*", F.posexplode(codes).alias("_place", "lang"))
    made = F.when(F.col("lang") == "en", F.col("paraphrase")).otherwise(translate(F.col("paraphrase"), F.col("lang")))
    numbered = copies.withColumns({"IDS": F.col("_place") * F.lit(n) + F.col("_at"), "paraphrase": made})
    return numbered.select("IDS", *[c for c in pairs.columns if c not in ("IDS", "lang", "index")], "lang", "index")


def renumber_augmented(augmented: DataFrame, langs: list[str]) -> DataFrame:
    """Unique ``IDS`` for the output of an augmentation: English first, then by language.

    The rows are stored as they come, and their keys alone are sorted. The numbers come back to
    the rows by runs of 64 stored rows, in which a source and its copies stay together, so
    that they are compressed to a fraction where they move and are stored. What it stores on the way is deleted.
    """
    spark, path = augmented.sparkSession, fresh_path(augmented.sparkSession, "augmented")
    with scratch(spark):
        numbered = _renumbered(augmented, langs)
        numbered.write.option("compression", CODEC).parquet(path)
    release_shuffles(spark)
    return spark.read.schema(numbered.schema).parquet(path)


def _renumbered(augmented: DataFrame, langs: list[str]) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(c) for c in ["en", *langs]]), F.col("lang"))
    stored = write_table(augmented.withColumn("_at", F.monotonically_increasing_id()), "augmented-rows")
    release_shuffles(augmented.sparkSession)
    keys = stored.select(place.alias("_place"), F.col("IDS").alias("_old"), "_at")
    numbers = row_index(keys, "_place", "_old", name="IDS").select("IDS", "_at")
    run = F.shiftright("_at", 6).alias("_run")
    lists = numbers.groupBy(run).agg(F.collect_list(F.struct("_at", "IDS")).alias("_numbers"))
    rows = stored.drop("IDS").withColumn("_run", run).join(lists.hint("shuffle_hash"), "_run")
    own = F.get(F.filter("_numbers", lambda e: e["_at"] == F.col("_at")), F.lit(0))["IDS"].alias("IDS")
    return rows.select(own, *[c for c in augmented.columns if c != "IDS"])
