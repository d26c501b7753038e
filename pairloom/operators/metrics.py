"""Classification metrics for any number of runs in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.constants import METRICS


def align(preds: DataFrame, gold: DataFrame, key: str = "IDS") -> DataFrame:
    """Predictions joined to gold labels on the row key."""
    return preds.join(gold, key)


def unmatched(preds: DataFrame, gold: DataFrame, key: str = "IDS", by: tuple[str, ...] = ()) -> DataFrame:
    """Matched rows, predictions without gold, and gold rows without prediction.

    With ``by`` a row for each run of ``preds``, all from one join; the key is unique in
    gold and in each run.
    """
    left = preds.select(key, *by, F.lit(1).alias("_p"))
    right = gold.select(key, F.lit(1).alias("_g"))
    has_p, has_g = F.col("_p").isNotNull(), F.col("_g").isNotNull()
    matched = F.count(F.when(has_p & has_g, 1)).alias("n_matched")
    only_pred = F.count(F.when(has_p & ~has_g, 1)).alias("n_only_pred")
    if not by:
        both = left.join(right, key, "full_outer")
        return both.agg(matched, only_pred, F.count(F.when(~has_p & has_g, 1)).alias("n_only_gold"))
    counted = left.join(right, key, "left").groupBy(*by).agg(matched, only_pred)
    whole = F.broadcast(gold.agg(F.count(F.lit(1)).alias("_all")))  # one row
    return counted.join(whole).withColumn("n_only_gold", F.col("_all") - F.col("n_matched")).drop("_all")


def confusion(
    df: DataFrame, *by: str, gold: str = "gold", pred: str = "pred", also: tuple[Column, ...] = ()
) -> DataFrame:
    """Four counts per group and ``n_invalid``, the rows whose label or prediction is
    null or not 0 or 1: one hash aggregate with map-side combine. ``also`` adds
    aggregates to it."""
    g, p = F.col(gold), F.col(pred)
    valid = F.coalesce(g.isin(0, 1) & p.isin(0, 1), F.lit(False))

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    return df.groupBy(*by).agg(
        count((g == 1) & (p == 1)).alias("tp"),
        count((g == 0) & (p == 1)).alias("fp"),
        count((g == 1) & (p == 0)).alias("fn"),
        count((g == 0) & (p == 0)).alias("tn"),
        count(~valid).alias("n_invalid"),
        *also,
    )


def refuse_invalid(counts: DataFrame) -> DataFrame:
    """Fail the job where rows are left out of the four counts."""
    message = F.concat(F.col("n_invalid").cast("string"), F.lit(" rows have a label or prediction that is not 0 or 1"))
    failed = F.raise_error(message).cast("bigint")
    return counts.withColumn("tp", F.when(F.col("n_invalid") > 0, failed).otherwise(F.col("tp")))


def with_metrics(counts: DataFrame) -> DataFrame:
    """The seven metrics from the four counts.

    Zero denominators give 0; the ROC area is null when gold has one class. The
    macro mean is over the classes that occur in gold or prediction.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    f1_pos = ratio(2 * tp, 2 * tp + fp + fn)
    f1_neg = ratio(2 * tn, 2 * tn + fp + fn)
    has_pos = F.when(tp + fp + fn > 0, 1).otherwise(0)
    has_neg = F.when(tn + fp + fn > 0, 1).otherwise(0)
    one_class = (tp + fn == 0) | (tn + fp == 0)
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, n),
            "macro_f1_score": ratio(f1_pos * has_pos + f1_neg * has_neg, has_pos + has_neg),
            "weighted_f1_score": ratio(f1_pos * (tp + fn) + f1_neg * (tn + fp), n),
            "f1_score": f1_pos,
            "precision_score": ratio(tp, tp + fp),
            "recall_score": ratio(tp, tp + fn),
            "ROC-AUC": F.when(~one_class, (tp / (tp + fn) + tn / (tn + fp)) / 2),
        }
    )


def evaluate_runs(
    df: DataFrame, *by: str, gold: str = "gold", pred: str = "pred", invalid: str = "raise"
) -> DataFrame:
    """All metrics per run; ``by`` names the run columns.

    A row whose label or prediction is null or not 0 or 1 fails the job, or with
    ``invalid="count"`` is counted in ``n_invalid`` and left out of the metrics.
    """
    counts = confusion(df, *by, gold=gold, pred=pred)
    if invalid == "count":
        return with_metrics(counts).drop("tp", "fp", "fn", "tn")
    if invalid != "raise":
        raise ValueError(f"invalid={invalid!r}")
    return with_metrics(refuse_invalid(counts)).drop("tp", "fp", "fn", "tn", "n_invalid")


def metric_report(results: DataFrame, *by: str, metrics: list[str] = METRICS) -> DataFrame:
    """One row per run and metric, sorted by name, as ``key = value`` and as a table line."""
    numbers = [F.col(f"`{m}`").cast("double").alias(m) for m in metrics]
    long = results.select(*by, *numbers).unpivot(list(by), [F.col(f"`{m}`") for m in metrics], "key", "value")
    shown = F.coalesce(F.col("value").cast("string"), F.lit("nan"))
    number = F.coalesce(F.format_string("%.6f", F.col("value")), F.lit("nan"))
    number = F.when(F.col("value").isNull(), F.lit("nan")).otherwise(number)
    return long.select(
        *by,
        "key",
        "value",
        F.concat("key", F.lit(" = "), shown).alias("line"),
        F.format_string("%20s: %s", "key", number).alias("table_line"),
    ).orderBy(*by, "key")


def result_records(results: DataFrame) -> DataFrame:
    """``{config: {model, langs, dataset}, results: {...}}`` per run."""
    return results.select(
        F.struct("model", "langs", "dataset").alias("config"),
        F.struct(*[F.col(f"`{m}`") for m in METRICS]).alias("results"),
    )
