"""Whole texts as numpy arrays of word hashes, and Arrow plumbing for tasks.

Words are found on UTF-8 bytes, all texts of a piece at once, so that a task costs a
few array operations for each piece and none for each word. A word's hash has 64 bits;
two different words of one comparison are taken for equal with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PIECE_BYTES = 1 << 19  # text bytes handled at once; one longer text is a piece of its own
HASH_BYTES = 1 << 18  # bytes for which 64-bit temporaries exist at once
BATCH_BYTES = 2 << 20  # sent to a worker together; Spark and the worker hold several times as much
BATCH_ROWS = 10_000  # Spark's own default
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**60)) * 8 + 5
_POWERS: dict[str, np.ndarray] = {}


def byte_class(words: Callable[[int], bool]) -> np.ndarray:
    """Value of each byte in a word; 0 outside words. A-Z count as a-z."""
    table = np.array([_VALUE[b] if words(b) else 0 for b in range(256)], dtype=np.uint64)
    table[65:91] = table[97:123]
    return table


#: `[^\x20\x09-\x0D]+` after lower-casing A-Z.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALPHANUMERIC = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker.

    Functions reach workers by value, so their globals last one task. What is kept
    here must be a pure function of its key: a lost worker only costs time.
    """
    module = sys.modules.setdefault("pairloom_worker_cache", types.ModuleType("pairloom_worker_cache"))
    return module.__dict__.setdefault("entries", {})


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES, in a session that has no such limit of its own.

    Spark's default counts rows: ten thousand texts of some KB are tens of MB, for each task
    and in the executor and the worker alike.
    """
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)


def release_memory() -> None:
    """Give the memory that a task has freed back to the system.

    A worker outlives its task, also between two stages, and would keep its largest use.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (one to one)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, HASH_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and where each begins (one more at the end).

    Null is an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.type not in (pa.string(), pa.large_string()):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()  # no copy
    kind = np.int32 if texts.type == pa.string() else np.int64
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_places(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and last byte + 1 of every word; texts are never joined."""
    inside = (table != 0)[data]
    edge = np.empty(len(data) + 1, dtype=bool)  # no word runs over this place
    edge[0] = edge[-1] = True
    edge[1:-1] = ~inside[:-1]
    edge[at] = True
    begins = np.flatnonzero(inside & edge[:-1])
    edge[1:-1] = ~inside[1:]
    edge[at] = True
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return begins, ends


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, HASH_BYTES at a time (or one longer word)."""
    out = np.empty(len(begins), dtype=np.uint64)
    i = 0
    while i < len(begins):
        lo = begins[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + HASH_BYTES, "right")))
        hi = ends[j - 1]
        up, down = _powers(hi - lo)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - lo] - sums[begins[i:j] - lo]) * down[begins[i:j] - lo]
        i = j
    return mix(out)


def words_of(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words before each text (one more at the end)."""
    data, at = text_bytes(texts)
    begins, ends = word_places(data, at, table)
    return word_hashes(data, begins, ends, table), np.searchsorted(begins, at)


def shingles_of(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words, with the text it is in; a shorter text, not empty, is one run."""
    n = len(hashes)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    total = hashes.copy()
    for j in range(1, min(k, n)):
        total[: n - j] = total[: n - j] * np.uint64(_BASE) + mix(hashes[j:] + np.uint64(j))
    whole = np.arange(n) + k <= first[1:][text]
    out, where = mix(total[whole]), text[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = count[short].astype(np.uint64)
        for j in range(k - 1):
            more = j < count[short]
            word = hashes[np.minimum(first[short] + j, n - 1)]
            extra = np.where(more, mix(extra * np.uint64(_BASE) + word), extra)
        out, where = np.concatenate([out, extra]), np.concatenate([where, short])
    return out, where


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` text bytes each, and at least one row."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def filled(batches: Iterator[pa.RecordBatch], column: str, limit: int, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The ``pieces`` of every run of ``rows`` rows, however the batches are cut."""
    held: list[pa.RecordBatch] = []
    seen = size = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - seen)
            batch = batch.slice(part.num_rows)
            held.append(part)
            seen, size = seen + part.num_rows, size + len(text_bytes(part.column(column))[0])
            if seen == rows or size > limit:
                *some, last = pieces(pa.concat_batches(held), column, limit)
                held, size = [last], len(text_bytes(last.column(column))[0])
                if seen == rows:
                    some, held, seen, size = [*some, last], [], 0, 0
                del part, last
                yield from some
                del some
        del batch
    if held:
        yield pa.concat_batches(held)


def batch_of(columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def list_of(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column from all values and the number in each row."""
    at = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, type=kind))


def with_columns(
    df: DataFrame,
    text: str,
    result: str,
    make: Callable[[pa.RecordBatch], dict],
    keep: list[str] | None = None,
    mask: str | None = None,
    limit: int = PIECE_BYTES,
    needs: list[str] = (),
) -> DataFrame:
    """Add the columns that ``make`` computes from runs of rows, in one pass without shuffle.

    ``result`` is their schema (DDL). ``keep`` names the input columns to return (all
    by default); input columns with a result's name, in any case, give way to it. With
    ``mask`` only rows where that result is true return, and the result itself does not.
    """
    small_batches(df.sparkSession)
    new = T._parse_datatype_string(result)
    taken = {f.name.lower() for f in new if f.name != mask}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    sent = list(dict.fromkeys([*kept, text, *needs]))
    fields = [f for f in new if f.name != mask]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, limit):
                made = make(piece)
                out = {c: piece.column(c) for c in kept} | {c: made[c] for c in names}
                got = batch_of(out)
                yield got.filter(pa.array(made[mask])) if mask else got
                del piece, made, out, got
            del batch  # else it would stay until the next one is read
            release_memory()

    return df.select(*(f"`{c}`" for c in sent)).mapInArrow(run, schema)
