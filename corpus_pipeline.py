"""From raw documents to packed training sequences, one operator after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.decontaminate import remove_leaks
from pairloom.llm.packing import pack
from pairloom.llm.quality import fit_quality, select_quality
from pairloom.llm.queries import remainder, table, tokenizer_path
from pairloom.llm.similarity import one_of_each
from pairloom.llm.toxicity import fit_toxicity, remove_toxic
from pairloom.shared import write_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is probably 1 or more; a fifth of the labels takes no part in the fit."""
    return select_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), remainder(5) != 0))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.5, learned from the same labels."""
    return remove_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder(5) != 0))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near copies: five-word shingles, similarity 0.8."""
    return one_of_each(docs, words=5, threshold=(80, 100))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("n-gram jaccard join", without_copies),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: Learned scores and greedy packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads what the one before has stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
