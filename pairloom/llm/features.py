"""Bounded samples of labelled rows, and the fits that use them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 6_000  # labelled rows a fit may use
SAMPLE_CHARS = 2_000_000  # of the text that a sampled row may have to be used in a fit


def labelled_sample(
    docs: DataFrame, labels: DataFrame, train: Column, label: str, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """At most ``rows`` labelled training documents: key, text, label.

    Only labels whose key is in ``docs`` are chosen from, so labels of documents that an
    earlier stage has removed take no place. Those with the smallest hashes of (key, label)
    are taken, whatever their order; rows without key or label take no part. A key that
    several rows of ``docs`` share counts once, with its smallest text (null: empty). So the
    result has ``rows`` rows at most; few labels are broadcast, and only their texts move.
    Texts longer than SAMPLE_CHARS are left out of fits.
    """
    own = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    chosen = (
        labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"))
        .withColumnRenamed("key", key)
        .filter(F.col(key).isNotNull() & F.col("label").isNotNull() & train)
        .distinct()
        .withColumnRenamed(key, "key")
        .join(own.select("key").distinct(), "key", "left_semi")
        .orderBy(F.xxhash64("key", "label"), "key", "label")
        .limit(rows)
    )
    texts = own.join(F.broadcast(chosen), "key").filter(F.char_length("text") <= SAMPLE_CHARS)
    return texts.groupBy("key", "label").agg(F.min("text").alias("text")).select("key", "text", "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.clip(x, -60, 60)))


def minimise(value_and_slope, start: np.ndarray, steps: int = 400, tolerance: float = 1e-7) -> np.ndarray:
    """Nesterov's accelerated descent with step halving, for smooth convex functions."""
    x = y = start.astype(float)
    size, momentum = 1.0, 1.0
    best = np.inf
    for _ in range(steps):
        value, slope = value_and_slope(y)
        norm = float(slope @ slope)
        if norm < tolerance**2:
            break
        while True:
            new = y - size * slope
            reached = value_and_slope(new)[0]
            if reached <= value - 0.5 * size * norm or size < 1e-12:
                break
            size *= 0.5
        if reached > best:  # overshot: start again from here without momentum
            momentum, y, best = 1.0, x, np.inf
            continue
        following = 0.5 * (1 + np.sqrt(1 + 4 * momentum**2))
        y = new + (momentum - 1) / following * (new - x)
        done = abs(best - reached) < tolerance * max(1.0, abs(reached))
        x, momentum, best = new, following, reached
        size *= 1.1
        if done:
            break
    return x
