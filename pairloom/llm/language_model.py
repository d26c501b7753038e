"""Bigram language model in a log-frequency Bloom filter.

A count c is kept as its quantised logarithm, level q: the n-gram is put into a Bloom
filter together with 1, 2, ... q. A lookup asks for the n-gram with 1, 2, ... until the
filter says no, so a level costs a few bits and is never underestimated. The filter
is cut into slices by n-gram hash. Each slice is built in one task from counts that were
added up before the shuffle, and the slices are broadcast to the scoring workers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.text import SPACED, batch_of, mix, pieces, with_columns, words_of
from pairloom.shared import write_table

BASE = 1.5  # of the quantised logarithm
ENTRY_BITS = 12  # filter bits for each (n-gram, level)
PROBES = 5
ADD = 0.1  # to every unigram count
WEIGHT, TRUST = 0.4, 4.0  # bigram weight: WEIGHT * c / (c + TRUST) for a context seen c times
FLUSH_TOKENS = 3_000_000  # counted together before they leave a task
PASS_BYTES = 256 << 20  # of the model sent to the workers at once
SCORE_BYTES = 1 << 20  # of text scored at once
_END, _START = np.uint64(0x1F3D5B79), np.uint64(0x2E4C6A88)
_UNIGRAM, _BIGRAM = 1, 2
_KEY_BYTES = 5  # of a bigram inside its slice; two collide with a chance of keys * 2**-40


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then one end) and the number before each text."""
    words, first = words_of(texts, SPACED)
    at = first + np.arange(len(first))
    out = np.full(at[-1], _END)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[np.arange(len(words)) + text] = words
    return out, at


def _bigrams(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = _START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def _values(levels: np.ndarray) -> np.ndarray:
    """A count for each level: 0, 1, then the middle of the level on a log scale."""
    return np.where(levels <= 1, levels, BASE ** (levels - 0.5))


def _mask(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash that picks the filter word, and the bits of the key in it."""
    h = mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 % 2**64))
    bits, mask = mix(h + np.uint64(1)), np.zeros(len(keys), dtype=np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((bits >> np.uint64(6 * i)) & np.uint64(63))
    return h >> np.uint64(20), mask


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[new], np.add.reduceat(counts[order], new) if len(keys) else counts


def count_ngrams(docs: DataFrame, text: str, n_slices: int) -> DataFrame:
    """Counts by order and slice, packed: order, slice, keys, counts.

    Tokens of one order and slice leave a task as one row with sorted 40-bit keys (64-bit
    ones of words) and their counts, so a frequent word is one key of each row, however
    often it occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            for order, parts in ((_UNIGRAM, [h[0] for h in held]), (_BIGRAM, [h[1] for h in held])):
                all_ = np.sort(np.concatenate(parts))
                new = np.flatnonzero(np.append(True, all_[1:] != all_[:-1]))
                counts = np.diff(np.append(new, len(all_))).astype(np.uint32)
                keys = all_[new]
                slices = (keys % np.uint64(n_slices)).astype(np.int64)
                by = np.argsort(slices, kind="stable")
                keys, counts, slices = keys[by], counts[by], slices[by]
                ends = np.searchsorted(slices, np.arange(n_slices + 1))
                some = np.flatnonzero(np.diff(ends))
                if order == _BIGRAM:
                    raw = (keys // np.uint64(n_slices)).view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]
                else:
                    raw = keys.view(np.uint8).reshape(-1, 8)
                yield batch_of(
                    {
                        "order": np.full(len(some), order, dtype=np.int32),
                        "slice": some.astype(np.int32),
                        "keys": pa.array([raw[ends[s] : ends[s + 1]].tobytes() for s in some], pa.binary()),
                        "counts": pa.array([counts[ends[s] : ends[s + 1]].tobytes() for s in some], pa.binary()),
                    }
                )

        for batch in batches:
            for piece in pieces(batch, text):
                tokens, first = _tokens(piece.column(text))
                held.append((tokens, _bigrams(tokens, first)))
                if sum(len(h[0]) for h in held) >= FLUSH_TOKENS:
                    yield from packed()
                    held.clear()
        if held:
            yield from packed()

    return docs.select(f"`{text}`").mapInArrow(run, "order int, slice int, keys binary, counts binary")


_SLICE = "order int, slice int, tokens bigint, distinct_keys bigint, filter binary, keys binary, counts binary"


def _build_slice(group: pa.Table) -> pa.Table:
    """Filter of one slice; words also keep their exact counts."""
    order = group.column("order")[0].as_py()
    raw = [b.as_py() for b in group.column("keys")]
    if order == _BIGRAM:
        parts = []
        for b in raw:
            wide = np.zeros((len(b) // _KEY_BYTES, 8), dtype=np.uint8)
            wide[:, :_KEY_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, _KEY_BYTES)
            parts.append(wide.view(np.uint64).ravel())
        keys = np.concatenate(parts)
    else:
        keys = np.frombuffer(b"".join(raw), np.uint64)
    counts = np.frombuffer(b"".join(b.as_py() for b in group.column("counts")), np.uint32).astype(np.int64)
    keys, counts = _add_up(keys, counts)
    levels = _levels(counts)
    words = np.zeros(max(1, -(-int(levels.sum()) * ENTRY_BITS // 64)), dtype=np.uint64)
    for level in range(1, int(levels.max()) + 1):
        h, mask = _mask(keys[levels >= level], level)
        np.bitwise_or.at(words, (h % np.uint64(len(words))).astype(np.int64), mask)
    exact = order == _UNIGRAM
    return pa.table(
        {
            "order": pa.array([order], pa.int32()),
            "slice": group.column("slice").slice(0, 1).combine_chunks(),
            "tokens": pa.array([int(counts.sum())]),
            "distinct_keys": pa.array([len(keys)]),
            "filter": pa.array([words.tobytes()], pa.binary()),
            "keys": pa.array([keys.tobytes() if exact else b""], pa.binary()),
            "counts": pa.array([counts.tobytes() if exact else b""], pa.binary()),
        }
    )


class Part:
    """Some slices of the model, as flat arrays."""

    def __init__(self, rows: Iterable, sizes: list, n_slices: int):
        """``sizes`` gives every row's order, slice, tokens, filter_bytes and key_bytes, so that
        each array is made once and filled slice by slice."""
        self.n_slices = n_slices
        self.at = {o: np.zeros(n_slices, dtype=np.int64) for o in (_UNIGRAM, _BIGRAM)}
        self.size = {o: np.zeros(n_slices, dtype=np.int64) for o in (_UNIGRAM, _BIGRAM)}
        total, keys_at, n_keys = {_UNIGRAM: 0, _BIGRAM: 0}, {}, 0
        for r in sizes:
            self.at[r["order"]][r["slice"]], self.size[r["order"]][r["slice"]] = total[r["order"]], r["filter_bytes"] // 8
            total[r["order"]] += r["filter_bytes"] // 8
            if r["key_bytes"]:
                keys_at[r["slice"]] = n_keys
                n_keys += r["key_bytes"] // 8
        self.filter = {o: np.zeros(n, dtype=np.uint64) for o, n in total.items()}
        # One more key at the end, above all others, so that a search needs no bound.
        self.keys = np.full(n_keys + 1, 2**64 - 1, dtype=np.uint64)
        total = sum(r["tokens"] for r in sizes if r["order"] == _UNIGRAM)
        self.counts = np.zeros(n_keys + 1, dtype=np.uint32 if total < 2**32 else np.int64)
        for r in rows:
            at, size = self.at[r["order"]][r["slice"]], self.size[r["order"]][r["slice"]]
            self.filter[r["order"]][at : at + size] = np.frombuffer(r["filter"], np.uint64)
            if r["keys"]:
                own = np.frombuffer(r["keys"], np.uint64)
                place = slice(keys_at[r["slice"]], keys_at[r["slice"]] + len(own))
                self.keys[place] = own
                self.counts[place] = np.frombuffer(r["counts"], np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.counts = self.keys[order], self.counts[order]

    @staticmethod
    def received(fields: dict) -> Part:
        """A part from the fields that were broadcast; workers need not have this module."""
        part = object.__new__(Part)
        part.__dict__.update(fields)
        bits = max(1, (len(part.keys) - 1).bit_length())
        part.shift = np.uint64(64 - bits)
        if "first" not in fields:  # made once in a task, and not sent
            starts = np.arange(1 << bits, dtype=np.uint64) << part.shift
            fields["first"] = np.searchsorted(part.keys, starts).astype(np.int32)
        part.first = fields["first"]
        return part

    def exact(self, tokens: np.ndarray) -> np.ndarray:
        """Exact counts of words; 0 for unknown ones."""
        at = self.first[(tokens >> self.shift).astype(np.int64)].astype(np.int64)
        open_ = np.flatnonzero(self.keys[at] < tokens)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.keys[at[open_]] < tokens[open_]]
        return np.where(self.keys[at] == tokens, self.counts[at], 0).astype(np.int64)

    def levels(self, order: int, hashes: np.ndarray) -> np.ndarray:
        """Quantised log counts by membership probes for level 1, 2, ... until a miss."""
        at, size, words = self.at[order], self.size[order], self.filter[order]
        slices = (hashes % np.uint64(self.n_slices)).astype(np.int64)
        keys = hashes
        if order == _BIGRAM:
            keys = (hashes // np.uint64(self.n_slices)) & np.uint64((1 << (8 * _KEY_BYTES)) - 1)
        out = np.zeros(len(hashes), dtype=np.uint8)
        active = np.flatnonzero(size[slices] > 0)
        level = 1
        while len(active):
            s = slices[active]
            h, mask = _mask(keys[active], level)
            word = words[at[s] + (h % size[s].astype(np.uint64)).astype(np.int64)]
            active = active[(word & mask) == mask]
            out[active] = level
            level += 1
        return out


def score(
    docs: DataFrame,
    train: Column,
    text: str = "text",
    keep: list[str] | None = None,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Score every row's whole text by a model of the rows where ``train`` is true.

    Tokens are words (lower-case A-Z, no ASCII white space) and one end for each text.
    Adds n_tokens, n_known (tokens with a training count), train_tokens, base_score (sum
    of log10 of add-0.1 unigram probabilities from exact counts) and score (log10 probability
    of the text by the model). The model mixes bigram and unigram probabilities, both from
    the filter: ``w * c(h, t) / c(h) + (1 - w) * (c(t) + 0.1) / (N + 0.1 * (V + 1))`` with
    ``w = WEIGHT * c(h) / (c(h) + TRUST)``.

    A null or empty text has the end token only. Repeated rows count and are scored as
    often as they occur. Where ``train`` is null the row is not training data. Without
    training rows nothing is known and N = V = 0. Input columns with a result's name give
    way to it. The model is sent in parts of at most ``pass_bytes`` (or one slice); with
    several parts the rows are stored between passes, with one byte per token for what
    has been found.
    """
    spark = docs.sparkSession
    n_slices = max(8, 2 * docs.rdd.getNumPartitions())
    counted = count_ngrams(docs.filter(F.coalesce(train, F.lit(False))), text, n_slices)
    model = write_table(counted.groupBy("order", "slice").applyInArrow(_build_slice, _SLICE), "language-model")
    sizes = model.select(
        "order",
        "slice",
        "tokens",
        "distinct_keys",
        F.octet_length("filter").alias("filter_bytes"),
        F.octet_length("keys").alias("key_bytes"),
    ).collect()
    n_train = sum(r.tokens for r in sizes if r.order == _UNIGRAM)
    n_distinct = sum(r.distinct_keys for r in sizes if r.order == _UNIGRAM)
    by_slice = np.zeros(n_slices)
    for r in sizes:
        by_slice[r.slice] += r.filter_bytes + 2 * r.key_bytes
    parts, held = [[]], 0
    for s, size in enumerate(by_slice):
        if held + size > pass_bytes and parts[-1]:
            parts.append([])
            held = 0
        parts[-1].append(s)
        held += size

    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    result = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    carried = ["_known", "_base", "_unigrams", "_bigrams"]
    found = "_known bigint, _base double, _unigrams binary, _bigrams binary"
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    total = n_train + ADD * (n_distinct + 1)

    def part_of(low: int, high: int, orders: tuple = (_UNIGRAM, _BIGRAM)) -> Part:
        rows = model.filter(F.col("slice").between(low, high) & F.col("order").isin(*orders))
        own = [r for r in sizes if low <= r["slice"] <= high and r["order"] in orders]
        return Part(rows.toLocalIterator(), own, n_slices)

    # Texts begin as often as they end.
    end = int(_END) % n_slices
    n_texts = float(Part.received(vars(part_of(end, end, (_UNIGRAM,)))).exact(np.array([_END]))[0])

    def make(piece: pa.RecordBatch, sent, low: int, high: int, first_pass: bool, last_pass: bool) -> dict:
        part = Part.received(sent.value)
        tokens, first = _tokens(piece.column(text))
        counts = np.diff(first)
        row = np.repeat(np.arange(len(counts)), counts)
        mine = (tokens % np.uint64(n_slices)).astype(np.int64)
        mine = (mine >= low) & (mine <= high)
        exact = part.exact(tokens)
        known = np.bincount(row, weights=mine & (exact > 0), minlength=len(counts)).astype(np.int64)
        base = np.add.reduceat(np.where(mine, np.log10((exact + ADD) / total), 0.0), first[:-1])
        levels = [part.levels(_UNIGRAM, tokens), part.levels(_BIGRAM, _bigrams(tokens, first))]
        if not first_pass:
            known = known + piece.column("_known").to_numpy()
            base = base + piece.column("_base").to_numpy()
            for j, name in enumerate(("_unigrams", "_bigrams")):
                old = np.frombuffer(b"".join(piece.column(name).to_pylist()), np.uint8)
                levels[j] = np.maximum(levels[j], old)
        if not last_pass:
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary()) for x in levels]
            return {"_known": known, "_base": base, "_unigrams": packed[0], "_bigrams": packed[1]}
        unigram, bigram = _values(levels[0].astype(np.int64)), _values(levels[1].astype(np.int64))
        context = np.empty_like(unigram)
        context[1:] = unigram[:-1]
        context[first[:-1]] = n_texts
        weight = WEIGHT * context / (context + TRUST)
        seen = np.minimum(bigram / np.maximum(context, 1.0), 1.0)
        p = weight * seen + (1 - weight) * (unigram + ADD) / total
        return {
            "n_tokens": counts,
            "n_known": known,
            "train_tokens": np.full(len(counts), n_train),
            "base_score": base,
            "score": np.add.reduceat(np.log10(p), first[:-1]),
        }

    out = docs
    for i, slices in enumerate(parts):
        low, high, last = int(slices[0]), int(slices[-1]), i + 1 == len(parts)
        sent = spark.sparkContext.broadcast(vars(part_of(low, high)))
        sent.__dict__.pop("_value", None)  # the driver keeps the file alone
        looked_up = functools.partial(make, sent=sent, low=low, high=high, first_pass=i == 0, last_pass=last)
        kept = columns if last else list(dict.fromkeys([*columns, text]))
        renamed = out.withColumnsRenamed({c: f"_old{c}" for c in carried}) if i else out
        needs = [f"_old{c}" for c in carried] if i else []
        step = looked_up if not i else lambda piece, f=looked_up: f(piece.rename_columns([c.removeprefix("_old") for c in piece.schema.names]))
        out = with_columns(renamed, text, result if last else found, step, kept, limit=SCORE_BYTES, needs=needs)
        if not last:
            out = write_table(out, "language-model-pass")
    return out
