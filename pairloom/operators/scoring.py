"""Scoring of pairs in batches, and a classifier that Spark itself can fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.constants import SCORING_BATCH
from pairloom.functions.labels import argmax, squeeze
from pairloom.functions.text import words
from pairloom.operators.metrics import evaluate_runs
from pairloom.schemas import require_columns
from pairloom.shared import worker_cache

BatchModel = Callable[[pd.DataFrame], list[list[float]]]


def score_pairs(
    df: DataFrame,
    load: Callable[..., BatchModel],
    batch: int = SCORING_BATCH["bert"],
    keep: tuple[str, ...] = ("IDS", "quality"),
    inputs: tuple[str, ...] = ("sentence", "paraphrase"),
    version: str | None = None,
    weights: str | None = None,
) -> DataFrame:
    """Add ``logits`` from a batch function.

    The gold label travels with the row, so predictions need no join to meet it.

    With ``version`` a Python worker loads the model once and keeps it for all its tasks,
    until it is asked for another version; without it each task loads it. ``weights`` names
    a file (in any file system that Spark reads) that every executor fetches once; ``load``
    then gets the path of its copy.
    """
    if weights is not None:
        df.sparkSession.sparkContext.addFile(weights)
    require_columns(df, *keep, *inputs)
    columns = list(dict.fromkeys([*keep, *inputs]))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def loaded() -> BatchModel:
        make = load if weights is None else lambda: load(SparkFiles.get(weights.rstrip("/").rsplit("/", 1)[-1]))
        if version is None:
            return make()
        cache = worker_cache()
        if "model" not in cache or cache["model"][0] != version:
            cache.pop("model", None)  # one model at a time
            cache["model"] = (version, make())
        return cache["model"][1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded()
        for frame in frames:
            logits: list[list[float]] = []
            for at in range(0, len(frame), batch):
                chunk = frame.iloc[at : at + batch]
                answer = [[float(x) for x in row] for row in model(chunk[list(inputs)])]
                if len(answer) != len(chunk):
                    raise ValueError(f"{len(chunk)} rows sent, {len(answer)} scored")
                logits.extend(answer)
            yield frame[list(keep)].assign(logits=logits)

    return df.select(*columns).mapInPandas(run, f"{out}, logits array<double>")


def with_predictions(scored: DataFrame, regression: bool = False) -> DataFrame:
    """Add ``pred``: the class of the largest logit, or the single output."""
    pick = squeeze if regression else argmax
    return scored.withColumn("pred", pick(F.col("logits")))


def evaluate_split(
    pairs: DataFrame,
    split: str,
    load: Callable[[], BatchModel],
    batch: int = SCORING_BATCH["bert"],
) -> DataFrame:
    """The metrics of a batch model on one split of a prepared corpus."""
    rows = pairs.filter(F.col("split") == split)
    scored = with_predictions(score_pairs(rows, load, batch))
    return evaluate_runs(scored, gold="quality")


def _word_sets(pairs: DataFrame) -> DataFrame:
    """Words that both texts have, and words that only one has."""
    sets = pairs.withColumns(
        {
            "_a": F.array_distinct(words(F.col("sentence"))),
            "_b": F.array_distinct(words(F.col("paraphrase"))),
        }
    )
    return sets.withColumns(
        {
            "_both": F.array_intersect("_a", "_b"),
            "_one": F.concat(F.array_except("_a", "_b"), F.array_except("_b", "_a")),
        }
    ).drop("_a", "_b")


def pair_features(pairs: DataFrame) -> DataFrame:
    """``IDS``, ``quality`` and the numbers of words that both texts and only one have."""
    sets = _word_sets(pairs)
    return sets.select("IDS", "quality", F.size("_both").alias("n_both"), F.size("_one").alias("n_one"))


def fit_word_ratios(train: DataFrame) -> DataFrame:
    """``kind, word, weight``: how much a word that both texts share (``both``), or only one
    has (``one``), speaks for quality 1, in millionths of a natural log ratio.

    The ratio is of the word's smoothed shares of the positive and the negative
    pairs. Weights are whole numbers from whole counts, so sums of them do not depend
    on their order. The row without kind and word is the ratio of the classes.
    """
    require_columns(train, "sentence", "paraphrase", "quality")
    sets = _word_sets(train.filter(F.col("quality").isin(0, 1)))
    entry = lambda name, kind: F.transform(name, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    rows = sets.select("quality", F.explode(F.concat(entry("_both", "both"), entry("_one", "one"))).alias("e"))
    positive, one = F.sum(F.col("quality")), F.count(F.lit(1))
    counts = rows.groupBy("e.kind", "e.word").agg(positive.alias("p"), (one - positive).alias("n"))
    whole = sets.agg(positive.alias("all_p"), (one - positive).alias("all_n"))
    share = lambda c, total: (F.col(c) + 1).cast("double") / (F.col(total) + 2)
    ratio = lambda p, n: F.round(F.log(p / n) * 1_000_000).cast("bigint").alias("weight")
    words_ = counts.join(F.broadcast(whole)).select("kind", "word", ratio(share("p", "all_p"), share("n", "all_n")))
    none = F.lit(None).cast("string")
    classes = whole.select(
        none.alias("kind"), none.alias("word"), ratio((F.col("all_p") + 1).cast("double"), (F.col("all_n") + 1).cast("double"))
    )
    return words_.unionByName(classes)


def classify_by_ratios(ratios: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``score``, the sum of the weights of a pair's words and of the classes, and
    ``pred``, whether it is above 0. Unknown words weigh nothing.

    Weights meet the words by a join, so the model may be larger than memory; the
    scores are added up before they return to the rows by ``IDS``, a unique key.
    """
    sets = _word_sets(pairs.select("IDS", "sentence", "paraphrase"))
    entry = lambda name, kind: F.transform(name, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    rows = sets.select("IDS", F.explode(F.concat(entry("_both", "both"), entry("_one", "one"))).alias("e"))
    known = ratios.filter(F.col("kind").isNotNull())
    sums = rows.select("IDS", "e.*").join(known, ["kind", "word"]).groupBy("IDS").agg(F.sum("weight").alias("_sum"))
    base = F.broadcast(ratios.filter(F.col("kind").isNull()).select(F.col("weight").alias("_base")))
    score = F.col("_base") + F.coalesce("_sum", F.lit(0))
    scored = pairs.join(sums, "IDS", "left").join(base).withColumn("score", score).drop("_sum", "_base")
    return scored.withColumn("pred", F.when(F.col("score") > 0, 1).otherwise(0))


def fit_classifier(train: DataFrame, features: int = 1 << 16, iterations: int = 20) -> PipelineModel:
    """Logistic regression on the weighted words that the two texts share or do not.

    The two word sets are the product and the absolute difference of the texts'
    binary word vectors, built without leaving the JVM. The model's size is set
    by ``features``, not by the data.
    """
    require_columns(train, "sentence", "paraphrase", "quality")
    stages = []
    for name in ("_both", "_one"):
        stages.append(
            HashingTF(inputCol=name, outputCol=f"{name}_tf", numFeatures=features, binary=True)
        )
        stages.append(IDF(inputCol=f"{name}_tf", outputCol=f"{name}_idf"))
    stages.append(VectorAssembler(inputCols=["_both_idf", "_one_idf"], outputCol="_features"))
    stages.append(
        LogisticRegression(
            featuresCol="_features",
            labelCol="quality",
            rawPredictionCol="_raw",
            probabilityCol="_probability",
            predictionCol="_prediction",
            maxIter=iterations,
            regParam=0.01,
        )
    )
    return Pipeline(stages=stages).fit(_word_sets(train))


def classify(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Add ``logits`` and ``pred`` of a fitted classifier."""
    scored = model.transform(_word_sets(pairs)).withColumn("logits", vector_to_array("_raw"))
    return with_predictions(scored.select(*pairs.columns, "logits"))
