"""Periodic runs in word sequences by maximal pairs.

A run is a stretch with smallest period q, at least 2q long, that cannot be extended. Its
first word and the one q further are the starts of a maximal pair: the words from both on
agree for exactly (length - q) words, and the words before both differ. So runs are the
maximal pairs whose distance is no more than their common length, and nothing has to be
extended afterwards.

The pairs come from the LCP-interval tree, bottom up. The list of a tree node holds its
suffixes by place, each with its class, the word before it. When two children join, only
neighbours in the joined list can be a run's pair: an occurrence between them would give
the stretch a smaller period. So a join costs the smaller list, and pairs of one class
are passed over. A run of 12 words or more has a common length of 6 or more, so only
suffixes that share their first 6 words with another one are sorted and enter the tree.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.text import SPACED, mix, text_bytes, with_columns, word_hashes, word_places

LEAST = 12  # words of a run
TEXT_BYTES = 2 << 20  # of text handled at once
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
#: `[^\x20\x09-\x0D]+` as spelled.
SPELLED = np.where(_UPPER, mix(SPACED), SPACED)


def _repeated(words: np.ndarray, doc: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Places whose next k words occur again in the same document, and those k further on."""
    n = len(words)
    if n <= k:
        return np.zeros(0, dtype=np.int64)
    total = mix(doc.astype(np.uint64) + np.uint64(1))
    for j in range(k):
        total[: n - j] = mix(total[: n - j] * np.uint64(3) + words[j:])
    whole = np.flatnonzero(np.arange(n) + k <= end)
    if not len(whole):
        return whole
    order = whole[np.argsort(total[whole], kind="stable")]
    same = total[order[1:]] == total[order[:-1]]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    further = np.flatnonzero(again) + k
    again[further[further < end[further - k]]] = True
    return np.flatnonzero(again)


def _sorted_suffixes(words: np.ndarray, doc: np.ndarray, end: np.ndarray, at: np.ndarray, k: int):
    """Order of the suffixes at places ``at``, and how many words each shares with the one before it.

    Prefix doubling: ranks by the first k words, then twice as many, among suffixes that
    still share a rank. Common lengths are found on these ranks from the longest down. A
    common length below k counts as 0.
    """
    m = len(at)
    number = np.full(len(words) + 1, -1, dtype=np.int64)  # of the suffix at a place
    number[at] = np.arange(m)
    keys = []
    for j in range(k - 1, -1, -1):
        inside = at + j < end[at]
        keys.append(np.where(inside, words[np.minimum(at + j, len(words) - 1)], 0))
        keys.append(inside)
    keys.append(doc[at])
    order = np.lexsort(keys)
    new = np.zeros(m, dtype=bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    rank = np.empty(m, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    ranks, size = [rank], k
    while True:
        shared = np.bincount(rank, minlength=m)[rank] > 1
        some = np.flatnonzero(shared)
        if not len(some):
            break
        following = at[some] + size
        inside = following < end[at[some]]
        second = np.where(inside, rank[number[np.where(inside, following, 0)]] + 1, 0)
        by = some[np.argsort(rank[some] * np.int64(m + 1) + second, kind="stable")]
        second_by = np.empty(m, dtype=np.int64)
        second_by[some] = second
        old, second = rank[by], second_by[by]
        first = np.append(True, old[1:] != old[:-1])
        part = first | np.append(True, second[1:] != second[:-1])
        i = np.arange(len(by))
        rank = rank.copy()
        rank[by] = old + np.maximum.accumulate(np.where(part, i, 0)) - np.maximum.accumulate(np.where(first, i, 0))
        ranks.append(rank)
        size *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(m, dtype=np.int64)
    close = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = at[order[close - 1]], at[order[close]]
    far = len(words)
    length = np.zeros(len(close), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = number[np.minimum(a + length, far)], number[np.minimum(b + length, far)]
        equal = (x >= 0) & (y >= 0) & (ranks[level][x] == ranks[level][y])
        length += np.where(equal, k << level, 0)
    for _ in range(k - 1):
        x, y = a + length, b + length
        equal = (x < end[a]) & (y < end[b])
        equal &= words[np.minimum(x, far - 1)] == words[np.minimum(y, far - 1)]
        go = equal if _ == 0 else go & equal
        length += go
    common[close] = length
    return order, common


def _joined(large: list, small: list, common: int, least: int, place: list, left: list, out: list) -> list:
    """Join two children of a node; report neighbours that are a run's maximal pair."""
    if len(small) > len(large):
        large, small = small, large
    last = len(small) - 1
    for n, x in enumerate(small):
        i = bisect_left(large, x)
        if i and (n == 0 or small[n - 1] < large[i - 1]):
            y = large[i - 1]
            p = place[x] - place[y]
            if p <= common and p + common >= least and left[x] != left[y]:
                out.append((place[y], p + common, p))
        if i < len(large) and (n == last or small[n + 1] > large[i]):
            y = large[i]
            p = place[y] - place[x]
            if p <= common and p + common >= least and left[x] != left[y]:
                out.append((place[x], p + common, p))
    if last < 8:
        for x in small:
            insort(large, x)
        return large
    return sorted(large + small)


def _pairs(order: list, common: list, least: int, place: list, left: list) -> list:
    """Walk the LCP-interval tree bottom up. A common length of 0 ends a tree."""
    out: list = []
    stack: list = []  # open nodes: [common length, list]
    done = [order[0]] if order else []
    for at in range(1, len(order) + 1):
        here = common[at] if at < len(order) else 0
        while stack and stack[-1][0] > here:
            length, own = stack.pop()
            done = _joined(own, done, length, least, place, left, out)
        if here:
            if stack and stack[-1][0] == here:
                stack[-1][1] = _joined(stack[-1][1], done, here, least, place, left, out)
            else:
                stack.append([here, done])
        if at < len(order):
            done = [order[at]]
    return out


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of all documents: rows of (start, length, period), by start, then period.

    ``words`` are numbers of 64 bits, ``first`` the first word of each document and the
    end. Starts count over all documents.
    """
    k = max(1, (least + 1) // 2)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    end = first[1:][doc]
    at = _repeated(words, doc, end, k)
    if not len(at):
        return np.zeros((0, 3), dtype=np.int64)
    order, common = _sorted_suffixes(words, doc, end, at, k)
    inside = common > 0
    inside[:-1] |= common[1:] > 0
    left = np.where(at > first[doc[at]], words[at - 1], 0)
    begins = at == first[doc[at]]
    # one number for each class; the beginning of a document is a class of its own
    _, classes = np.unique(left, return_inverse=True)
    classes = np.where(begins, -1, classes)
    found = _pairs(order[inside].tolist(), common[inside].tolist(), least, at.tolist(), classes.tolist())
    runs = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
    return runs[np.lexsort([runs[:, 2], runs[:, 0]])]


def _collapsed(data: np.ndarray, at: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Kept words of each text, joined by one space."""
    some = np.flatnonzero(kept)
    text = np.searchsorted(first, some, "right") - 1
    more = np.append(text[1:] == text[:-1], False) if len(some) else np.zeros(0, dtype=bool)
    data = np.append(data, np.uint8(32))
    data[ends[some[more]]] = 32  # white space: another word of the text follows
    change = np.zeros(len(data) + 1, dtype=np.int8)
    change[begins[some]] += 1
    change[ends[some] + more] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    size = np.concatenate([[0], np.cumsum(inside)])[at]
    return pa.Array.from_buffers(
        pa.large_string(), len(at) - 1, [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[inside])]
    ).cast(pa.string())


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """Adds n_words, runs (array of start, length, period, by start, then period) and collapsed.

    Words are runs of characters but ASCII white space, as spelled, numbered from 0; they
    are compared by 64-bit hashes. A run has ``least`` words or more, and twice its smallest
    period. ``collapsed`` is the text without what repeats: the words that lie in no run
    after its first period, joined by one space.

    One pass over whole texts, without shuffle. A null or empty text has no words, no runs
    and an empty ``collapsed``. Repeated rows get the same result, no rows give none. Input
    columns with a result's name, in any case, give way to it.
    """
    result = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def make(piece: pa.RecordBatch) -> dict:
        data, at = text_bytes(piece.column(text))
        begins, ends = word_places(data, at, SPELLED)
        first = np.searchsorted(begins, at)
        runs = runs_of(word_hashes(data, begins, ends, SPELLED), first, least)
        change = np.zeros(len(begins) + 1, dtype=np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(change[:-1]) == 0
        doc = np.searchsorted(first, runs[:, 0], "right") - 1
        columns = [pa.array(c) for c in (runs[:, 0] - first[doc], runs[:, 1], runs[:, 2])]
        values = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
        return {
            "n_words": np.diff(first),
            "runs": pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(at))).astype(np.int32)), values),
            "collapsed": _collapsed(data, at, begins, ends, first, kept),
        }

    return with_columns(docs, text, result, make, keep, limit=TEXT_BYTES)
