"""The three raw layouts brought to the pair schema, and row-wise views of it.

All of these are column expressions: no shuffle, and they accept a streaming
DataFrame as well as a batch one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.constants import LABELS
from pairloom.functions.labels import binary_label, score_of
from pairloom.functions.text import quora_text
from pairloom.schemas import require_columns


def normalize_mrpc(df: DataFrame) -> DataFrame:
    """``#1 String``, ``#2 String``, ``Quality`` to the augmented pair schema."""
    require_columns(df, "IDS", "#1 String", "#2 String", "Quality", "lang", "index")
    return df.select(
        "IDS",
        F.col("`#1 String`").alias("sentence"),
        F.col("`#2 String`").alias("paraphrase"),
        F.col("Quality").alias("quality"),
        "lang",
        "index",
    )


def parse_twitter(df: DataFrame, strict: bool = True) -> DataFrame:
    """Columns ``IDS, c0, c1, c2`` to pairs whose quality is the raw score."""
    require_columns(df, "IDS", "c0", "c1", "c2")
    return df.select(
        "IDS",
        F.col("c0").alias("sentence"),
        F.col("c1").alias("paraphrase"),
        score_of(F.col("c2"), strict).alias("quality"),
    )


def binarize_scores(df: DataFrame) -> DataFrame:
    """Drop the undecided score 3, then 4 and more is 1 and the rest 0."""
    clear = df.filter(~F.col("quality").eqNullSafe(3))
    return clear.withColumn("quality", binary_label(F.col("quality")))


def normalize_twitter(df: DataFrame, strict: bool = True) -> DataFrame:
    return binarize_scores(parse_twitter(df, strict))


def rename_quora(df: DataFrame) -> DataFrame:
    require_columns(df, "id", "question1", "question2", "is_duplicate")
    return df.select(
        F.col("id").alias("IDS"),
        F.col("question1").alias("sentence"),
        F.col("question2").alias("paraphrase"),
        F.col("is_duplicate").alias("quality"),
    )


def clean_quora(df: DataFrame) -> DataFrame:
    return df.withColumns({c: quora_text(F.col(c)) for c in ("sentence", "paraphrase")})


def normalize_quora(df: DataFrame) -> DataFrame:
    return clean_quora(rename_quora(df))


def filter_languages(df: DataFrame, langs: list[str]) -> DataFrame:
    """Rows whose language is in ``langs``; a null language never is."""
    return df.filter(F.coalesce(F.col("lang").isin(list(langs)), F.lit(False)))


def as_examples(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("IDS").alias("guid"),
        F.col("sentence").alias("text_a"),
        F.col("paraphrase").alias("text_b"),
        F.col("quality").alias("label"),
    )


def label_counts(df: DataFrame, label: str = "quality") -> DataFrame:
    """Rows per label, and whether the label is one the scorer knows."""
    known = F.coalesce(F.col(label).isin(LABELS), F.lit(False))
    return df.groupBy(F.col(label).alias("label"), known.alias("known")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
