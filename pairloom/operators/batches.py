"""Lists of texts cut into batches of n, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.constants import SCORING_BATCH, TRANSLATION_BATCH
from pairloom.functions.labels import cross_entropy
from pairloom.operators.keys import row_index


def batch_texts(
    df: DataFrame, text: str, *order: str | Column, n: int = TRANSLATION_BATCH
) -> DataFrame:
    """Rows ``batch_id, texts`` with ``n`` texts each, in order; the last is shorter.

    The batch of a row follows from its dense index, so a group never has more
    than ``n`` rows.
    """
    indexed = row_index(df, *order, name="_i").select("_i", text)
    return (
        indexed.groupBy(F.floor(F.col("_i") / n).alias("batch_id"))
        .agg(F.sort_array(F.collect_list(F.struct("_i", F.col(text).alias("t")))).alias("_items"))
        .select("batch_id", F.col("_items.t").alias("texts"))
    )


def flatten_batches(batches: DataFrame) -> DataFrame:
    """The texts of ``batch_texts`` again, one row each, with their place."""
    return batches.select("batch_id", F.posexplode("texts").alias("pos", "text"))


def evaluation_loss(
    scored: DataFrame, place: str = "IDS", batch: int = SCORING_BATCH["bert"], logits: str = "logits", label: str = "quality"
) -> DataFrame:
    """``eval_loss, n_batches``: the mean over batches of the mean cross-entropy of their rows.

    ``place`` is a dense row index from 0 in evaluation order, so that batches are runs of
    ``batch`` rows. A row whose label has no logit fails the job.
    """
    lost = F.raise_error(F.lit("a row has no logit for its label")).cast("double")
    loss = F.coalesce(cross_entropy(F.col(logits), F.col(label)), lost)
    found = mean_of_batch_means(scored.withColumn("_loss", loss), "_loss", F.floor(F.col(place) / batch))
    return found.withColumnRenamed("mean_of_means", "eval_loss")


def mean_of_batch_means(df: DataFrame, value: str, batch: Column) -> DataFrame:
    """The plain mean of the means per batch (a short last batch counts in full)."""
    means = df.groupBy(batch.alias("_b")).agg(F.avg(value).alias("_m"))
    return means.agg(F.avg("_m").alias("mean_of_means"), F.count(F.lit(1)).alias("n_batches"))
