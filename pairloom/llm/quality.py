"""Quality classifier: ordinal regression with cumulative logits over hashed text.

All grades share one weight for each hashed feature and differ only in ordered
thresholds: P(grade <= k) = sigmoid(threshold_k - w.x). This gives an expected grade and
the probability of at least a wanted grade, by which documents are selected. The features
are words, pairs of neighbouring words and the shapes of text, each hashed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from pairloom.llm.features import SAMPLE_ROWS, labelled_sample, minimise, sigmoid
from pairloom.llm.text import SPACED, mix, shingles_of, text_bytes, with_columns, word_hashes, word_places

SHAPES = 2048  # hashed features of shapes
WORDS = 2048  # hashed words and pairs of words
BUCKETS = SHAPES + WORDS
WORD_WEIGHT = 0.5  # of words beside shapes, in a feature vector of length 1
RIDGE = 1e-5
FEATURE_BYTES = 2 << 20  # of text turned into features at once
FEATURE_ROWS = 1024  # texts counted at once


def _classes() -> np.ndarray:
    """Byte classes of the shape features: letters, digits and blanks by kind, other signs one by one."""
    out = np.arange(256, dtype=np.uint64)
    out[ord("a") : ord("z") + 1] = 1000
    out[ord("A") : ord("Z") + 1] = 1001
    out[ord("0") : ord("9") + 1] = 1002
    out[128:] = 1000  # letters of other alphabets, mostly
    return mix(out)


_CLASS = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: square roots of the shares of hashed features, and their length 1.

    The hashed shapes are three neighbouring byte classes, word shapes after one another,
    and whether a word repeats one of the two before it. Words (A-Z lower-cased) and pairs
    of neighbouring words are hashed to features of their own. An empty text is a row of
    zeros.
    """
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i in range(0, len(texts), FEATURE_ROWS):
        _count_features(texts.slice(i, FEATURE_ROWS), out[i : i + FEATURE_ROWS])
    return out


def _count_features(texts: pa.Array, out: np.ndarray) -> None:
    """Fill in the rows of a few texts."""
    n = len(texts)
    data, at = text_bytes(texts)
    size = np.diff(at)

    def add(hashes: np.ndarray, row: np.ndarray, weight: float, first: int, count: int) -> None:
        cell = row * count + (hashes % np.uint64(count)).astype(np.int64)
        found = np.bincount(cell, minlength=n * count).reshape(n, count)
        share = found / np.maximum(np.bincount(row, minlength=n), 1)[:, None]
        out[:, first : first + count] += weight * np.sqrt(share)

    half = SHAPES // 2
    if len(data) > 2:
        row = np.repeat(np.arange(n), size)
        kind = _CLASS[data]
        inside = np.arange(len(data) - 2) + 2 < at[1:][row[:-2]]
        grams = mix(mix(kind[:-2] + np.uint64(3)) + kind[1:-1] * np.uint64(5) + kind[2:] * np.uint64(7))
        add(grams[inside], row[:-2][inside], 1.0, 0, half)
    begins, ends = word_places(data, at, SPACED)
    first = np.searchsorted(begins, at)
    words = word_hashes(data, begins, ends, SPACED)
    if len(words):
        row = np.repeat(np.arange(n), np.diff(first))
        place = np.arange(len(words)) - first[row]
        repeats = np.zeros(len(words), dtype=np.uint64)
        for lag in (1, 2):
            same = np.zeros(len(words), dtype=bool)
            same[lag:] = words[lag:] == words[:-lag]
            repeats[same & (place >= lag) & (repeats == 0)] = lag
        # first and last byte class of the word and its length
        shape = mix(_CLASS[data[begins]] + _CLASS[data[ends - 1]] * np.uint64(3) + np.minimum(ends - begins, 12).astype(np.uint64))
        add(shape, row, 1.0, half, half - 8)
        add(repeats, row, 1.0, SHAPES - 8, 3)
        runs = [shingles_of(words, first, k) for k in (1, 2)]
        paired = np.diff(first)[runs[1][1]] > 1  # a single word is no pair
        hashes = np.concatenate([runs[0][0], runs[1][0][paired]])
        add(hashes, np.concatenate([runs[0][1], runs[1][1][paired]]), WORD_WEIGHT, SHAPES, WORDS)
    out /= np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


class CumulativeLink:
    """Shared weights and ordered thresholds over grades in rising order."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def at_least(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= each grade but the lowest), a column for each."""
        return sigmoid((x @ self.weights)[:, None] - self.thresholds)

    def expected(self, x: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, dtype=float))
        return self.grades[0] + self.at_least(x) @ steps if len(steps) else np.full(len(x), float(self.grades[0]))

    def tail(self, x: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= the given one)."""
        above = [i for i, g in enumerate(self.grades[1:]) if g >= grade]
        if grade <= self.grades[0]:
            return np.ones(len(x))
        return self.at_least(x)[:, above[0]] if above else np.zeros(len(x))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> CumulativeLink:
    """Maximum likelihood of the grades with a ridge on the weights.

    The likelihood of a grade is the difference of two neighbouring cumulative
    probabilities; its negative logarithm is convex in weights and thresholds together and
    keeps the thresholds in order. Without two grades the results are constant.
    """
    grades = sorted({int(g) for g in y})
    width = x.shape[1] if x.ndim == 2 else BUCKETS
    if len(grades) < 2:
        return CumulativeLink(grades or [0], np.zeros(width), np.zeros(0))
    x, rank, rows = x.astype(np.float32), np.searchsorted(grades, y), np.arange(len(x))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, cut = p[:width], p[width:]
        below = sigmoid(cut - (x @ w.astype(np.float32)).astype(float)[:, None])  # P(grade < each threshold's)
        edge = np.pad(below, ((0, 0), (1, 1)), constant_values=((0, 0), (0, 1)))
        likely = edge[rows, rank + 1] - edge[rows, rank]
        if (likely <= 0).any() or (np.diff(cut) <= 0).any():
            return np.inf, np.zeros_like(p)
        slope = edge * (1 - edge)  # of the cumulative probabilities by their thresholds
        up, down = slope[rows, rank + 1] / likely / len(x), slope[rows, rank] / likely / len(x)
        by_cut = np.bincount(rank + 1, weights=-up, minlength=len(cut) + 2) + np.bincount(rank, weights=down, minlength=len(cut) + 2)
        by_w = (x.T @ (up - down).astype(np.float32)).astype(float) + ridge * w
        return float(-np.log(likely).mean() + 0.5 * ridge * (w @ w)), np.concatenate([by_w, by_cut[1:-1]])

    below = np.cumsum(np.bincount(rank, minlength=len(grades)))[:-1] / len(x)
    found = minimise(loss, np.concatenate([np.zeros(width), np.log(below / (1 - below))]))
    return CumulativeLink(grades, found[:width], found[width:])


def fit_quality(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS
) -> CumulativeLink:
    """Fit on at most ``rows`` labelled rows where ``train`` (on the key) is true.

    Features are made in the tasks; the driver gets ``rows`` feature vectors at most.
    """
    sample = labelled_sample(docs, labels, train, label, key, text, rows)
    made = with_columns(
        sample.select("key", "label", "text"),
        "text",
        "x binary",
        lambda piece: {"x": pa.array([r.tobytes() for r in features(piece.column("text")).astype(np.float16)], pa.binary())},
        ["key", "label"],
        limit=FEATURE_BYTES,
    )
    found = made.toArrow().sort_by([("key", "ascending"), ("label", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS)
    return fit(x, found.column("label").to_numpy())


def grade(
    docs: DataFrame, model: CumulativeLink, at_least: int = 1, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Adds expected_grade, tail_probability (of ``at_least``) and selected (tail of 0.5 or more).

    One pass over the whole texts, no shuffle. A null text is empty; an empty text has no
    features and gets what the thresholds alone say. Repeated rows get the same result.
    Input columns with a result's name give way to it.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.grades, model.weights, model.thresholds))

    def make(piece: pa.RecordBatch) -> dict:
        x, own = features(piece.column(text)), CumulativeLink(*sent.value)
        tail = own.tail(x, at_least)
        return {"expected_grade": own.expected(x), "tail_probability": tail, "selected": tail >= 0.5}

    result = "expected_grade double, tail_probability double, selected boolean"
    return with_columns(docs, text, result, make, keep, limit=FEATURE_BYTES)


def select_quality(docs: DataFrame, model: CumulativeLink, at_least: int = 1, text: str = "text") -> DataFrame:
    """The rows that ``grade`` selects, with their columns only."""
    sent = docs.sparkSession.sparkContext.broadcast((model.grades, model.weights, model.thresholds))

    def make(piece: pa.RecordBatch) -> dict:
        return {"_selected": CumulativeLink(*sent.value).tail(features(piece.column(text)), at_least) >= 0.5}

    return with_columns(docs, text, "_selected boolean", make, mask="_selected", limit=FEATURE_BYTES)
