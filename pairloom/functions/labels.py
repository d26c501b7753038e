"""Scores, labels and logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_of(text: Column, strict: bool = True) -> Column:
    """The second character of a text such as ``(4, 6)`` as a number.

    ``strict`` fails on bad text; otherwise bad text gives null, which the
    caller can count as a reject.
    """
    digit = F.substring(text, 2, 1)
    return digit.cast("int") if strict else digit.try_cast("int")


def binary_label(score: Column) -> Column:
    """1 from a score of 4 on, else 0."""
    return F.when(score >= 4, F.lit(1)).otherwise(F.lit(0))


def argmax(logits: Column) -> Column:
    """Position of the largest entry, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def squeeze(logits: Column) -> Column:
    """The only entry of a regression output."""
    return F.get(logits, F.lit(0))


def cross_entropy(logits: Column, label: Column) -> Column:
    """The loss of a row: log-sum-exp of its logits less the logit of its class.

    The largest logit is taken out before the exponentials, so logits of any size neither
    overflow nor lose the loss. A null label, or one without a logit, gives null.
    """
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return top + F.log(total) - F.get(logits, label)


def rank_key(key: Column, seed: int) -> Column:
    """A text that orders rows at random, the same on every run and layout."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
