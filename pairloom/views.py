"""The given tables seen as the corpora, memories and predictions the queries need.

Each view exists twice: as a DataFrame for the queries, and as SQL text (written
on its own, in ``oracles.py``) for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.constants import TARGET_LANGUAGES
from pairloom.functions.labels import binary_label
from pairloom.shared import fresh_path, spread, write_table

IDS_STEP = 1_000_000  # pairs of a document that have keys of their own
CUTS = [("bert", 200), ("xlnet", 500), ("roberta", 1000), ("albert", 2000)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pairs of neighbouring lines: 1 and 2, 3 and 4, and so on.

    All lines are used; a last line without a partner, or with an empty one, has
    a null paraphrase. ``IDS`` is unique, and ``index`` joins ten documents.
    """
    lines = F.split("text", "\n", -1)
    even = F.filter("lines", lambda x, i: i % 2 == 0)
    odd = F.filter("lines", lambda x, i: i % 2 == 1)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    docs = docs.filter(F.col("text").isNotNull())
    cut = docs.select("doc_id", "lang", lines.alias("lines"))
    rows = cut.select("doc_id", "lang", F.posexplode_outer(F.arrays_zip(even.alias("a"), odd.alias("b"))))
    texts = rows.select(
        F.when(F.col("pos") < IDS_STEP, F.col("doc_id") * IDS_STEP + F.col("pos"))
        .otherwise(F.raise_error(F.lit("a document has too many pairs for its keys")).cast("bigint"))
        .alias("IDS"),
        F.col("col.a").alias("sentence"),
        F.nullif(F.col("col.b"), F.lit("")).alias("paraphrase"),
        "lang",
        F.expr("doc_id div 10").alias("index"),
    )
    size = F.length("sentence") + F.coalesce(F.length("paraphrase"), F.lit(0))
    scored = texts.withColumn("score", (size % 7).cast("int"))
    return scored.withColumn("quality", binary_label(F.col("score")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs`` with the columns of an augmented corpus only."""
    return pairs(spark, sf_dir).select("IDS", "sentence", "paraphrase", "quality", "lang", "index")


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English pairs, also those without a paraphrase."""
    return pairs(spark, sf_dir).filter(F.col("lang") == "en").select("IDS", "sentence", "paraphrase", "quality")


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation memory for all texts of ``english``, both directions.

    The foreign text is the code, a colon and the text; the way back gives the
    text itself for two languages, and the lower-cased text for the others. The texts are stored, as
    each direction reads them.
    """
    codes = F.array(*[F.lit(c) for c in TARGET_LANGUAGES])
    texts = english(spark, sf_dir).select(F.col("paraphrase").alias("t")).dropna().distinct()
    texts = write_table(texts, "memory-texts")
    each = texts.withColumn("code", F.explode(codes))
    foreign = F.concat("code", F.lit(":"), "t")
    there = each.select(
        F.lit("en").alias("src"), F.col("code").alias("tgt"), F.col("t").alias("src_text"), foreign.alias("tgt_text")
    )
    back = each.select(
        F.col("code").alias("src"),
        F.lit("en").alias("tgt"),
        foreign.alias("src_text"),
        rule_translation(F.col("t"), F.col("code")).alias("tgt_text"),
    )
    return there.unionByName(back)


def rule_translation(text, lang):
    return F.when(lang.isin("es", "ja"), text).otherwise(F.lower(text))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("IDS"), F.col("quality").alias("gold")
    )


def _rule_models(docs: DataFrame) -> DataFrame:
    """Four rule models over documents: is the text at least so long?"""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("cut")) for m, c in CUTS])
    return docs.withColumn("m", F.explode(models)).select(
        "m.model",
        F.lit("docs").alias("dataset"),
        F.col("lang").alias("langs"),
        F.when(F.col("n_chars") >= F.col("m.cut"), 1).otherwise(0).alias("pred"),
        *[c for c in ("IDS", "gold") if c in docs.columns],
    )


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("IDS"), "lang", "n_chars")


def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the rule models for every document."""
    return _rule_models(_sizes(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for the labelled documents beside their gold labels.

    The join comes before the models, so a document is shuffled once, not once
    per model.
    """
    return _rule_models(_sizes(spark, sf_dir).join(gold(spark, sf_dir), "IDS"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def write_mrpc_file(spark: SparkSession, pairs: DataFrame) -> str:
    """Raw lines in ``IDS`` order: label, two ids, two texts; no quoting.

    A missing paraphrase is an empty field at the line's end, which the reader strips.
    """
    path = fresh_path(spark, "raw-mrpc")
    lines = pairs.orderBy("IDS").select(
        F.col("quality").alias("Quality"),
        F.col("IDS").alias("#1 ID"),
        (F.col("IDS") + 1).alias("#2 ID"),
        F.col("sentence").alias("#1 String"),
        F.col("paraphrase").alias("#2 String"),
    )
    _write_csv(lines, path, sep="\t", header=True, quote="")
    return path


def write_twitter_file(spark: SparkSession, pairs: DataFrame) -> str:
    """Raw quoted rows in ``IDS`` order without a header."""
    path = fresh_path(spark, "raw-tpc")
    rows = pairs.orderBy("IDS").select(
        F.col("sentence").alias("c0"),
        F.col("paraphrase").alias("c1"),
        F.format_string("(%d, 6)", "score").alias("c2"),
        F.lit("u").alias("c3"),
    )
    _write_csv(rows, path, sep="\t", header=False, quoteAll=True, escape='"')
    return path


def write_pairs_csv(spark: SparkSession, pairs: DataFrame) -> str:
    """A saved corpus in ``IDS`` order: header, and the row index in the first column."""
    path = fresh_path(spark, "saved-pairs")
    rows = pairs.orderBy("IDS").select(F.col("IDS").alias("Unnamed: 0"), *pairs.columns)
    _write_csv(rows, path, header=True, quoteAll=True, escape='"')
    return path


def _write_csv(df: DataFrame, path: str, **options) -> None:
    df.write.options(
        emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options
    ).csv(path)
