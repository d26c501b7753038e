"""Iterative fits whose steps are Spark aggregates, with stored states and evaluations.

The model is a logistic one over sparse features. A step is one aggregate over its batch
of training rows: each task adds up its rows' part of the gradient for each feature, and
the parts are added up by feature. So what is shuffled in a step is one row for each
feature and task, whatever the rows. The state, one weight for each feature, is written
after every step; a fit that is started again goes on after the last one written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.constants import METRICS, SPLIT_SEED
from pairloom.functions.labels import cross_entropy, rank_key
from pairloom.operators.metrics import confusion, refuse_invalid, with_metrics
from pairloom.operators.scoring import pair_features, with_predictions
from pairloom.schemas import require_columns
from pairloom.shared import committed_parts, write_table

HEX = 7  # digits of a rank key that deal a row to a batch
FEATURES = "array<struct<feature:int,value:double>>"


def pair_vector(pairs: DataFrame) -> DataFrame:
    """``IDS, quality, features``: a constant, and the shares of words that both texts and only one have."""
    sized = pair_features(pairs)
    whole = F.col("n_both") + F.col("n_one") + 1
    values = [F.lit(1.0), F.col("n_both") / whole, F.col("n_one") / whole]
    entries = [F.struct(F.lit(i).alias("feature"), v.cast("double").alias("value")) for i, v in enumerate(values)]
    return sized.select("IDS", "quality", F.array(*entries).cast(FEATURES).alias("features"))


def _weights(state: DataFrame) -> DataFrame:
    """The state as one row with a dense array, small by the number of features."""
    rows = F.sort_array(F.collect_list(F.struct("feature", "weight")))
    return state.agg(F.transform(rows, lambda r: r["weight"]).alias("_w"))


def _margin() -> Column:
    part = lambda s, f: s + f["value"] * F.coalesce(F.get(F.col("_w"), f["feature"]), F.lit(0.0))
    return F.aggregate("features", F.lit(0.0), part)


def score_by_state(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``logits`` (for class 0 and 1) and ``pred`` to rows with ``features``."""
    require_columns(rows, "features")
    margin = rows.join(F.broadcast(_weights(state))).withColumn("_m", _margin())
    scored = margin.withColumn("logits", F.array(F.lit(0.0), F.col("_m"))).drop("_w", "_m")
    return with_predictions(scored)


def _gradient(state: DataFrame, rows: DataFrame) -> DataFrame:
    """``feature, slope``: the mean slope of the loss over the rows."""
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n")))
    error = 1 / (1 + F.exp(-F.col("_m"))) - F.col("quality")
    parts = rows.join(F.broadcast(_weights(state))).withColumn("_m", _margin()).select(error.alias("_e"), F.explode("features").alias("_f"))
    sums = parts.groupBy(F.col("_f.feature").alias("feature")).agg(F.sum(F.col("_e") * F.col("_f.value")).alias("_sum"))
    return sums.join(n).select("feature", (F.col("_sum") / F.col("_n")).alias("slope"))


def batch_of(key: str, epoch: int, batches: int, seed: int = SPLIT_SEED) -> Column:
    """The batch of a row in an epoch: dealt by hash, another way in each epoch."""
    return F.conv(F.substring(rank_key(F.col(key), seed + epoch), 1, HEX), 16, 10).cast("bigint") % batches


def rate_at(step: int, steps: int, rate: float, warmup: int = 0) -> float:
    """A linear rise over ``warmup`` steps, then a linear fall to 0 after the last step."""
    return rate * step / warmup if step < warmup else rate * (steps - step) / max(1, steps - warmup)


def _evaluation(state: DataFrame, dev: DataFrame) -> DataFrame:
    """One row: the mean loss and the metrics on the dev rows."""
    scored = score_by_state(state, dev).withColumn("_loss", cross_entropy(F.col("logits"), F.col("quality")))
    counts = confusion(scored, gold="quality", also=(F.avg("_loss").alias("dev_loss"),))
    return with_metrics(refuse_invalid(counts)).drop("tp", "fp", "fn", "tn", "n_invalid")


def fit_epochs(
    train: DataFrame,
    dev: DataFrame,
    path: str,
    n_features: int,
    epochs: int = 3,
    batches: int = 1,
    rate: float = 1.0,
    warmup: int = 0,
    every: int | None = None,
    key: str = "IDS",
) -> DataFrame:
    """``step, epoch, dev_loss`` and the metrics at every evaluation, from the fit stored at ``path``.

    ``train`` and ``dev`` have ``quality`` (0 or 1) and ``features`` with numbers below
    ``n_features``; ``train`` has the row key that deals it to ``batches`` in each epoch. Both
    are read in every step and should be stored tables. The dev rows are evaluated after ``every`` steps
    (an epoch by default) and after the last one.

    States and evaluations are committed one by one. Run again with the same arguments,
    the fit goes on after its last state, so an interrupted fit ends like an uninterrupted
    one. Sums of floating-point numbers depend on the partitioning in the last digits:
    weights agree within 1e-9 of each other for any partitioning of the same rows.
    """
    require_columns(train, key, "quality", "features")
    require_columns(dev, "quality", "features")
    spark, steps = train.sparkSession, epochs * batches
    every = every or batches
    states, reports = f"{path}/states", f"{path}/reports"
    done, told = committed_parts(spark, states, "step"), committed_parts(spark, reports, "step")
    if 0 not in done:
        zeros = spark.range(n_features).select(F.col("id").cast("int").alias("feature"), F.lit(0.0).alias("weight"))
        _store(zeros.coalesce(1), states, 0)
        done.add(0)
    for step in range(max(done), steps):
        epoch = step // batches
        rows = train if batches == 1 else train.filter(batch_of(key, epoch, batches) == step % batches)
        state = read_state(spark, path, step)
        moved = state.join(F.broadcast(_gradient(state, rows)), "feature", "left")
        down = rate_at(step, steps, rate, warmup) * F.coalesce("slope", F.lit(0.0))
        _store(moved.select("feature", (F.col("weight") - down).alias("weight")).coalesce(1), states, step + 1)
    for step in range(1, steps + 1):
        if (step % every == 0 or step == steps) and step not in told:
            report = _evaluation(read_state(spark, path, step), dev)
            _store(report.withColumn("epoch", F.lit(-(-step // batches))), reports, step)
    return spark.read.parquet(reports).select("step", "epoch", "dev_loss", *[F.col(f"`{m}`") for m in METRICS])


def _store(df: DataFrame, folder: str, step: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/step={step}")


def read_state(spark: SparkSession, path: str, step: int) -> DataFrame:
    return spark.read.schema("feature int, weight double").parquet(f"{path}/states/step={step}")


def best_step(reports: DataFrame, by: str = "f1_score") -> int:
    """The evaluated step with the highest metric, the first one on ties."""
    return reports.orderBy(F.col(f"`{by}`").desc_nulls_last(), "step").first()["step"]


def best_state(spark: SparkSession, path: str, by: str = "f1_score") -> DataFrame:
    """The stored state of ``best_step``."""
    return read_state(spark, path, best_step(spark.read.parquet(f"{path}/reports"), by))


def stored_vectors(split: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Stored features of the train and dev rows of a table with ``split``."""
    parts = (pair_vector(split.filter(F.col("split") == s)) for s in ("train", "dev"))
    train, dev = (write_table(p, name) for p in parts)
    return train, dev
