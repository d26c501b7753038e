"""Benchmark decontamination with suffix arrays of the training texts.

The training texts are cut into shards, runs of rows with a bounded number of bytes.
Each shard gets a suffix array over its words; all suffixes of all test items are
binary-searched in it together, which gives their longest verbatim matches, where they
are, and the places of every test window. A shard is a run of rows inside one input
split, so nothing is shuffled, and a lost task rebuilds its own shards.
"""

from __future__ import annotations

import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.text import ALPHANUMERIC, list_of, with_columns, word_hashes, word_places, text_bytes, words_of
from pairloom.shared import write_table

SHARD_BYTES = 6 << 20  # of text, where items are many; a longer text is a shard of its own
LEAST_SHARD = 1 << 20  # all items are searched in each shard, which a shard of this size outweighs where they are few
TEST_BYTES = 32 << 20  # of item text sent to the workers at once
WINDOW = 10


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``ranks`` (all >= 0) in the order of their first ``depth`` values.

    The first sort packs as many ranks as fit into one key; every later one multiplies the
    sorted depth by that number and touches only suffixes that still tie.
    """
    n = len(ranks)
    if not n:
        return np.zeros(0, dtype=np.int64)
    bits = int(max(n, int(ranks.max()) + 1)).bit_length()
    per = max(2, 63 // bits)

    def key(rank: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        out = rank[at].astype(np.int64)
        for j in range(1, per):
            to = at + j * step
            out = (out << bits) | np.where(to < n, rank[np.minimum(to, n - 1)], 0)
        return out

    keys = key(ranks, np.arange(n), 1)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(n, dtype=bool)  # slots whose suffix differs from the one before
    new[1:] = keys[1:] != keys[:-1]
    sorted_to = per
    while sorted_to < depth:
        last = np.empty(n, dtype=bool)
        last[-1], last[:-1] = True, new[1:]
        slots = np.flatnonzero(~(new & last))
        if not len(slots):
            break
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
        at = order[slots]
        keys = key(rank, at, sorted_to)
        by = np.argsort(keys)
        order[slots] = at[by]
        keys = keys[by]
        differs = np.ones(len(slots), dtype=bool)
        differs[1:] = keys[1:] != keys[:-1]
        new[slots] |= differs
        sorted_to *= per
    return order


def narrow(ranks, order, lo, hi, wanted, depth):
    """For each interval of the suffix array, the part whose value at ``depth`` is ``wanted``."""
    n = len(ranks)

    def bound(lo, hi, after):
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            at = order[mid] + depth
            value = np.where(at < n, ranks[np.minimum(at, n - 1)], 0)
            right = value <= wanted[open_] if after else value < wanted[open_]
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    return bound(lo, hi, False), bound(lo, hi, True)


class Tests:
    """Words of all test items, sent to the workers."""

    def __init__(self, items: list, hashes: np.ndarray, first: np.ndarray, window: int):
        self.items, self.hashes, self.first, self.window = items, hashes, first, window
        counts = np.diff(first)
        self.item = np.repeat(np.arange(len(counts)), counts)  # of each test word
        self.left = first[1:][self.item] - np.arange(len(hashes))  # words to the item's end
        self.depth = int(counts.max(initial=1))
        size = np.minimum(counts, window)[self.item]  # of the window that begins here
        self.size = np.where(self.left >= size, size, 0)


def search(tests: Tests, hashes: np.ndarray, first: np.ndarray) -> dict:
    """Hit words, items and the longest match of each text of a shard."""
    n_texts = len(first) - 1
    count = np.diff(first)
    n = len(hashes)
    out = {
        "n_words": count,
        "hit": np.zeros(n, dtype=bool),
        "pairs": np.zeros((0, 2), dtype=np.int64),
        "longest": np.zeros(n_texts, dtype=np.int64),
        "longest_item": np.full(n_texts, -1),
        "longest_at": np.full(n_texts, -1),
    }
    if not n or not len(tests.hashes):
        return out
    vocabulary, ranks = np.unique(hashes, return_inverse=True)
    text = np.repeat(np.arange(n_texts), count)
    place = np.arange(n) + text  # with one separator, rank 0, after each text
    full = np.zeros(n + n_texts, dtype=np.int64)
    full[place] = ranks + 1
    order = suffix_array(full, tests.depth)

    found = np.minimum(np.searchsorted(vocabulary, tests.hashes), len(vocabulary) - 1)
    wanted = np.where(vocabulary[found] == tests.hashes, found + 1, -1)
    m = len(wanted)
    lo, hi = np.zeros(m, dtype=np.int64), np.full(m, len(full), dtype=np.int64)
    active = np.arange(m)
    least = np.where(tests.size > 0, tests.size, tests.window)
    matches = [np.zeros((0, 4), dtype=np.int64)]
    place_text = np.repeat(np.arange(n_texts), count + 1)
    doc_pairs = []
    depth = 0
    while len(active):
        a, b = narrow(full, order, lo[active], hi[active], wanted[active + depth], depth)
        some = a < b
        if depth:  # some places match no further
            fewer = active[((a != lo[active]) | (b != hi[active])) & (least[active] <= depth)]
            matches.append(np.stack([lo[fewer], hi[fewer], np.full(len(fewer), depth), tests.item[fewer]], 1))
        active, a, b = active[some], a[some], b[some]
        lo[active], hi[active] = a, b
        depth += 1
        whole = tests.size[active] == depth  # windows that end here occur
        if whole.any():
            starts, which = np.unique(a[whole], return_inverse=True)
            stops = np.zeros(len(starts), dtype=np.int64)
            np.maximum.at(stops, which, b[whole])
            sizes = stops - starts
            slots = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            at = order[slots]
            texts = place_text[at]
            change = np.zeros(len(full) + 1, dtype=np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + depth, -1)
            out["hit"] |= (np.cumsum(change)[:-1] > 0)[place]
            held = np.unique(np.stack([np.repeat(np.arange(len(starts)), sizes), texts], 1), axis=0)
            by_window = np.unique(np.stack([which, tests.item[active[whole]]], 1), axis=0)
            begin = np.searchsorted(by_window[:, 0], held[:, 0])
            n_items = np.searchsorted(by_window[:, 0], held[:, 0], "right") - begin
            rows = np.repeat(begin - np.cumsum(n_items) + n_items, n_items) + np.arange(n_items.sum())
            doc_pairs.append(np.stack([np.repeat(held[:, 1], n_items), by_window[rows, 1]], 1))
        whole = active[(tests.left[active] == depth) & (least[active] <= depth)]
        matches.append(np.stack([lo[whole], hi[whole], np.full(len(whole), depth), tests.item[whole]], 1))
        active = active[tests.left[active] > depth]
    if doc_pairs:
        out["pairs"] = np.unique(np.concatenate(doc_pairs), axis=0)

    # Longest match of each text: every interval in which places stop to match, at its greatest depth.
    found = np.concatenate(matches)
    found = found[np.lexsort([found[:, 3], -found[:, 2], found[:, 1], found[:, 0]])]
    found = found[np.unique(found[:, :2], axis=0, return_index=True)[1]]
    sizes = found[:, 1] - found[:, 0]
    at = order[np.repeat(found[:, 0] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    length, item = np.repeat(found[:, 2], sizes), np.repeat(found[:, 3], sizes)
    best = np.lexsort([item, at, -length, place_text[at]])
    texts, keep = np.unique(place_text[at[best]], return_index=True)
    best = best[keep]
    out["longest"][texts], out["longest_item"][texts] = length[best], item[best]
    out["longest_at"][texts] = at[best] - first[texts] - texts
    return out


def _test_blocks(tests: DataFrame, key: str, text: str, window: int) -> tuple[int, Iterator[Tests]]:
    """Number of blocks of about TEST_BYTES of text, and the items' words block by block: the driver holds one."""
    sized = write_table(
        tests.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")), "test-items"
    )
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // TEST_BYTES))

    def made(block: int) -> Tests:
        rows = sized.filter(F.pmod(F.xxhash64("key", "text"), F.lit(n_blocks)) == block).collect()
        rows.sort(key=lambda r: (str(r.key), r.text))
        keys = sorted({str(r.key) for r in rows})
        number = {k: i for i, k in enumerate(keys)}
        hashes, first = words_of(pa.array([r.text for r in rows], pa.string()), ALPHANUMERIC)
        found = Tests(keys, hashes, first, window)
        found.item = np.array([number[str(r.key)] for r in rows], dtype=np.int64)[found.item] if rows else found.item
        return found

    return n_blocks, (made(block) for block in range(n_blocks))


_RESULT = (
    "n_words bigint, hit_from array<int>, hit_to array<int>, hit_items array<string>, "
    "longest_match bigint, longest_item string, longest_at bigint"
)


def find_leaks(
    docs: DataFrame,
    tests: DataFrame,
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` with the verbatim passages they share with test items.

    A window is ``window`` consecutive words of an item, or all words of a shorter one.
    Adds n_words; hit_from and hit_to, the runs of words (first, last + 1) covered by
    occurrences of windows; hit_items, the items (as strings, sorted) with an occurring
    window; and the longest verbatim match of at least a window: its length in words
    (0: none), its item and its first word in the document.

    A null or empty text has no words, an item without words no windows. Rows are
    handled one by one, so repeated rows each get the same result, and empty tables
    give empty results or results without hits. Rows of ``tests`` with the same key are
    parts of one item. Input columns with a result's name give way to it. Items are sent
    to the workers in blocks of at most TEST_BYTES of text; with several blocks the rows
    are stored between passes.
    """
    n_blocks, blocks = _test_blocks(tests, item_key, item_text, window)
    names = [f.split()[0] for f in _RESULT.split(", ")]
    spark = docs.sparkSession
    out, sent = docs, None
    for i, block in enumerate(blocks):
        if i:  # what the pass before has found, stored; its items are not needed any more
            out = write_table(out, "leaks")
            sent.unpersist()
        sent = spark.sparkContext.broadcast(vars(block))  # plain fields: workers need not have this module
        before = names if i else []

        def make(piece: pa.RecordBatch) -> dict:
            tests = types.SimpleNamespace(**sent.value)
            data, at = text_bytes(piece.column(doc_text))
            begins, ends = word_places(data, at, ALPHANUMERIC)
            first = np.searchsorted(begins, at)
            got = search(tests, word_hashes(data, begins, ends, ALPHANUMERIC), first)
            items = [tests.items[i] for i in got["pairs"][:, 1]]
            item_counts = np.bincount(got["pairs"][:, 0], minlength=piece.num_rows)
            longest, longest_at = got["longest"], got["longest_at"]
            longest_item = [tests.items[i] if i >= 0 else None for i in got["longest_item"]]
            if before:
                at_row = np.cumsum(item_counts)
                merged = [
                    sorted({*items[e - c : e], *old})
                    for e, c, old in zip(at_row, item_counts, piece.column("hit_items").to_pylist())
                ]
                items, item_counts = [x for row in merged for x in row], np.array([len(x) for x in merged])
                rows = zip(piece.column("hit_from").to_pylist(), piece.column("hit_to").to_pylist(), first[:-1])
                for a, b, start in rows:
                    for x, y in zip(a, b):
                        got["hit"][start + x : start + y] = True
                old = piece.column("longest_match").to_numpy(zero_copy_only=False)
                older = old >= longest
                longest = np.where(older, old, longest)
                longest_at = np.where(older, piece.column("longest_at").fill_null(-1).to_numpy(zero_copy_only=False), longest_at)
                longest_item = [o if e else n for o, e, n in zip(piece.column("longest_item").to_pylist(), older, longest_item)]
            # runs of hit words, never joined over two texts
            hit = np.flatnonzero(got["hit"])
            text = np.searchsorted(first, hit, "right") - 1
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (text[1:] != text[:-1])
            last = np.ones(len(hit), dtype=bool)
            last[:-1] = new[1:]
            runs = np.bincount(text[new], minlength=piece.num_rows)
            return {
                "n_words": got["n_words"],
                "hit_from": list_of((hit - first[text])[new].astype(np.int32), runs),
                "hit_to": list_of((hit - first[text] + 1)[last].astype(np.int32), runs),
                "hit_items": list_of(items, item_counts, pa.string()),
                "longest_match": longest,
                "longest_item": pa.array(longest_item, pa.string()),
                "longest_at": pa.array(longest_at, mask=longest == 0),
            }

        kept = None if i or keep is None else list(dict.fromkeys([*keep, doc_text][: None if n_blocks > 1 else len(keep)]))
        limit = min(SHARD_BYTES, max(LEAST_SHARD, 8 * len(block.hashes)))
        out = _pass(out, doc_text, make, kept, before, limit)
    return out if keep is None else out.select(*(f"`{c}`" for c in keep if c.lower() not in names), *names)


def _pass(df, text, make, keep, before, limit):
    if not before:
        return with_columns(df, text, _RESULT, make, keep, limit=limit)
    hidden = {c: f"_before_{c}" for c in before}
    renamed = df.withColumnsRenamed(hidden)

    def with_names(piece: pa.RecordBatch) -> dict:
        return make(piece.rename_columns([c.removeprefix("_before_") for c in piece.schema.names]))

    return with_columns(renamed, text, _RESULT, with_names, keep, limit=limit).drop(*hidden.values())


def remove_leaks(docs: DataFrame, tests: DataFrame, doc_text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of a test item, with their columns only."""
    hidden = "_leak_"
    renamed = docs.withColumnsRenamed({c: hidden + c for c in docs.columns})
    found = find_leaks(renamed, tests, doc_text=hidden + doc_text, **options)
    clean = found.filter(F.size("hit_items") == 0).select(*(F.col(f"`{hidden}{c}`").alias(c) for c in docs.columns))
    return clean
