"""Packing of documents into training sequences by lexical retrieval.

Documents are dealt to shards by content: they are sorted by two min-hashes of their
words, so that texts with many common words lie together, and a shard is a run of them
with a bounded number of bytes. A shard has a BM25 inverted index over its words, and
documents are tokenised and packed in it. The document that a sequence
begins with is its seed; its unused nearest neighbours by BM25 fill the window, the last
one is cut at the window's end, and its rest begins the next window and is the next
seed. So sequences hold related documents and have no padding: only a shard's last tokens
do not fill a window, and are cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import copy
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.text import (
    SPACED,
    batch_of,
    byte_class,
    filled,
    mix,
    release_memory,
    text_bytes,
    with_columns,
    word_hashes,
    word_places,
    words_of,
    worker_cache,
)

WINDOW = 2048
END = 1  # the id after each document
SHARD_BYTES = 6 << 20  # of text that shares an index; a longer text is a shard of its own
K1, B = 1.2, 0.75
SHRUNK = 0.75  # share of an index's documents left unused below which the used ones leave it
BEST = 32  # neighbours that are sorted first; all of them where these do not fill a window
KNOWN_CHUNKS = 3_000_000  # remembered by a worker
_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes between ASCII white space, upper case apart: special tokens are spelled exactly.
CHUNKS = np.where(np.arange(256) - 65 < 26, np.where(np.arange(256) >= 65, mix(_SPACE), _SPACE), _SPACE)
_CLOSING = np.isin(np.arange(256), [ord(c) for c in ".,;:!?%$#&*"])
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_MARK = "<|startoftext|>"
_SIGN = "~"  # sent between chunks without it, where it has one id; special tokens take twice the time
#: Words and blanks whose joints show whether a tokenizer treats chunks apart.
_PROBE = ["Ab1", "x.", "é!", "don't", "(a)", "9,", "a.b", "$5%", "ß", "日本", "I'm:", "1990's", "--", "wait...", "e-mail;", "UPPER?", "#1", "a*", "«b»"]
_BLANKS = [" ", "\n", "\t", "  ", "\r\n", "\x0b", "\x0c"]


class Encoder:
    """Token ids of white-space chunks, remembered by hash.

    A tokenizer whose pattern never joins what white space separates, nor a letter or digit
    with a closing sign after it, gives for a text the ids of its chunks in order. Whether it
    does is tried on load, with a probe of such joints; any other tokenizer, or one without
    the mark that chunks are sent with, encodes whole texts.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.mark = self.tokenizer.token_to_id(_MARK)
        own = self.tokenizer.encode(_SIGN, add_special_tokens=False).ids
        self.sign = own[0] if len(own) == 1 else None
        self.by_chunk = self.mark is not None and self._special_are_marked() and self._splits()
        self.clear()

    def _special_are_marked(self) -> bool:
        """Whether all added tokens can be told by ``<|`` and have no white space in them."""
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        return all("<|" in t and not any(c.isspace() for c in t) for t in added)

    def _splits(self) -> bool:
        """Whether the probe's ids are those of its chunks."""
        probe = " " + "".join(w + _BLANKS[i % len(_BLANKS)] for i, w in enumerate(w for w in _PROBE for _ in _BLANKS))
        data, at = text_bytes(pa.array([probe]))
        begins, ends = _split_closing(data, *word_places(data, at, CHUNKS))
        raw = data.tobytes()
        chunks = [raw[b:e].decode() for b, e in zip(begins, ends)]
        parts = self.tokenizer.encode_batch([*chunks, probe], add_special_tokens=False)
        marked = self.tokenizer.encode(_MARK.join(chunks), add_special_tokens=False).ids
        of_chunks = [i for p in parts[:-1] for i in p.ids]
        signed = self.tokenizer.encode(f" {_SIGN} ".join(chunks), add_special_tokens=False).ids
        if of_chunks != [i for i in signed if i != self.sign]:
            self.sign = None
        return of_chunks == parts[-1].ids == [i for i in marked if i != self.mark]

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(1, dtype=np.int64)  # of the ids of chunk i, in self.ids
        self.where = np.zeros(0, dtype=np.int64)  # chunk number of each known hash
        self.ids = np.zeros(0, dtype=np.uint32)

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Encode new chunks, sorted by hash, a hundred in one call, with a sign or special token between them."""
        sign, between = (self.mark, _MARK) if self.sign is None else (self.sign, f" {_SIGN} ")
        own = lambda t: "<|" in t or self.sign is not None and _SIGN in t
        plain = ["" if own(t) else t for t in texts]
        sent = [plain[i : i + 100] for i in range(0, len(plain), 100)]
        made = self.tokenizer.encode_batch_fast([between.join(some) for some in sent], add_special_tokens=False)
        parts, counts = [], []
        for some, e in zip(sent, made, strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            cut = np.flatnonzero(ids == sign)
            if len(cut) != len(some) - 1 and self.sign is not None:  # other texts have its id too
                self.sign = None
                return self.learn(hashes, texts)
            parts.append(np.delete(ids, cut))
            counts.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
        ids, counts = np.concatenate(parts), np.concatenate(counts)
        odd = [i for i, t in enumerate(texts) if own(t)]
        if odd:
            ends = np.cumsum(counts)
            lists = np.split(ids, ends[:-1])
            for i in odd:
                lists[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
            ids, counts = np.concatenate(lists), np.array([len(x) for x in lists])
        first = len(self.at) - 1
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.where = np.insert(self.where, place, first + np.arange(len(hashes)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Chunk numbers of hashes; -1 for unknown ones."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.where[at], -1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids with END after each text, where each text's begin (one more at the end),
        and the chunk hashes with the text of each. ``order`` is then the stable order of these hashes, or None."""
        self.order = None
        if not self.by_chunk:
            return self._encode_whole(texts)
        if len(self.known) > KNOWN_CHUNKS:
            self.clear()
        data, at = text_bytes(texts)
        begins, ends = word_places(data, at, CHUNKS)
        begins, ends = _split_closing(data, begins, ends)
        hashes = word_hashes(data, begins, ends, CHUNKS)
        order = self.order = stable_order(hashes)
        sorted_ = hashes[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        distinct, one = sorted_[new], order[new]
        back = np.empty(len(order), dtype=np.int32)
        back[order] = np.cumsum(new, dtype=np.int32) - 1
        del sorted_, new
        chunk = self.find(distinct)
        missing = np.flatnonzero(chunk < 0)
        if len(missing):
            raw = data.tobytes()
            self.learn(distinct[missing], [raw[begins[i] : ends[i]].decode("utf-8", "replace") for i in one[missing]])
            del raw
            chunk = self.find(distinct)
        n = len(at) - 1
        text = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.searchsorted(begins, at)))
        del begins, ends, distinct, one
        size = (self.at[chunk + 1] - self.at[chunk])[back]
        counts = np.bincount(text, weights=size, minlength=n).astype(np.int64) + 1
        first = np.concatenate([[0], np.cumsum(counts)])
        ids = np.full(first[-1], END, dtype=np.uint32)
        inside = np.ones(first[-1], dtype=bool)
        inside[first[1:] - 1] = False
        shift = self.at[chunk][back] - np.cumsum(size) + size  # from a chunk's place among all ids to its known ids
        place = np.repeat(shift, size)
        del shift, size, back
        place += np.arange(len(place))
        ids[inside] = self.ids[place]
        return ids, first, hashes, text

    def _encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        made = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        first = np.concatenate([[0], np.cumsum([len(e.ids) + 1 for e in made])]).astype(np.int64)
        ids = np.array([i for e in made for i in (*e.ids, END)], dtype=np.uint32)
        data, at = text_bytes(texts)
        begins, ends = _split_closing(data, *word_places(data, at, CHUNKS))
        return ids, first, word_hashes(data, begins, ends, CHUNKS), np.searchsorted(at, begins, "right") - 1


def stable_order(hashes: np.ndarray) -> np.ndarray:
    """The stable argsort of hashes.

    Their upper bits with their places below them are sorted as plain numbers, which takes a tenth of
    the time; where two hashes have the same upper bits, the hashes themselves are sorted.
    """
    low = np.uint64(max(1, len(hashes)).bit_length())
    below = (np.uint64(1) << low) - np.uint64(1)
    order = hashes & ~below
    order |= np.arange(len(hashes), dtype=np.uint64)
    order.sort()
    order &= below
    order = order.view(np.int64)
    found = hashes[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(hashes, kind="stable")


def _split_closing(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut closing signs off chunks, where an ASCII letter or digit is before them."""
    if not len(begins):
        return begins, ends
    cut = ends.copy()
    open_ = np.flatnonzero(_CLOSING[data[cut - 1]] & (cut - begins > 1))
    while len(open_):
        cut[open_] -= 1
        open_ = open_[_CLOSING[data[cut[open_] - 1]] & (cut[open_] - begins[open_] > 1)]
    split = (cut < ends) & _ALNUM[data[cut - 1]]
    cut = np.where(split, cut, ends)
    place = np.arange(len(begins)) + np.cumsum(split) - split
    rest = place[split] + 1
    all_begins, all_ends = np.empty((2, len(begins) + len(rest)), dtype=begins.dtype)
    all_begins[place], all_ends[place] = begins, cut
    all_begins[rest], all_ends[rest] = cut[split], ends[split]
    return all_begins, all_ends


class Bm25:
    """Inverted index of a shard: for each term its documents and their BM25 weights."""

    def __init__(self, terms: np.ndarray, doc: np.ndarray, n_docs: int, order: np.ndarray | None = None):
        """``order`` is that of the terms, where the documents of the same term are in order, if it is known."""
        order = np.lexsort([doc, terms]) if order is None else order
        terms, doc = terms[order], doc[order]
        new = np.ones(len(terms), dtype=bool)
        new[1:] = (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(terms)))
        terms, self.doc = terms[start], doc[start]
        del order, new, start
        self.first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        self.first = np.append(self.first, len(terms))
        held = np.diff(self.first)
        idf = np.log1p((n_docs - held + 0.5) / (held + 0.5))
        length = np.bincount(doc, minlength=n_docs)
        norm = K1 * (1 - B + B * length / max(1.0, length.mean()))
        weight = np.repeat(idf, held) * count * (K1 + 1) / (count + norm[self.doc])
        self.weight = weight.astype(np.float32)
        del doc, terms, count, weight
        # the terms of each document that others have too, for it as a query
        shared = np.flatnonzero(held > 1)
        some = np.repeat(held > 1, held)
        number, doc = np.repeat(shared.astype(np.int32), held[shared]), self.doc[some]
        del some
        self.query = number[np.argsort(doc, kind="stable")]
        self.query_at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])
        self.n_docs = n_docs

    def only(self, docs: np.ndarray) -> Bm25:
        """The index without the entries of other documents, which stay queries; weights are those of the whole shard."""
        some = docs[self.doc]
        out = copy.copy(self)
        out.doc, out.weight = self.doc[some], self.weight[some]
        out.first = np.concatenate([[0], np.cumsum(some)])[self.first]
        return out

    def neighbours(self, seed: int, unused: np.ndarray, most: int | None = None) -> np.ndarray:
        """Unused documents with a term of the seed's, the best first, ties by place; the best ``most`` and those as good."""
        terms = self.query[self.query_at[seed] : self.query_at[seed + 1]]
        if not len(terms):
            return terms
        size = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n_docs)
        found = np.flatnonzero((score > 0) & unused)
        if most is not None and most < len(found):
            own = score[found]
            found = found[own >= np.partition(own, len(own) - most)[len(own) - most]]
        return found[np.lexsort([found, -score[found]])]


def content_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two min-hashes of each text's words, by which documents are sorted; texts without words come last."""
    hashes, first = words_of(texts, SPACED)
    some = np.flatnonzero(np.diff(first))
    out = []
    for seed in (1, 2):
        least = np.full(len(first) - 1, np.iinfo(np.int64).max)
        if len(some):
            spread = (mix(hashes + np.uint64(seed)) >> np.uint64(1)).astype(np.int64)
            least[some] = np.minimum.reduceat(spread, first[some])
        out.append(least)
    return out[0], out[1]


def _by_content(docs: DataFrame) -> DataFrame:
    """key and text, sorted by content; rows of equal content spread by key, then by place."""
    placed = with_columns(
        docs.withColumns({"by_key": F.xxhash64("key"), "row": F.monotonically_increasing_id()}),
        "text",
        "first bigint, second bigint",
        lambda piece: dict(zip(("first", "second"), content_places(piece.column("text")))),
    )
    return placed.orderBy("first", "second", "by_key", "row").select("key", "text")


def fill_order(index: Bm25, counts: np.ndarray, window: int) -> np.ndarray:
    """Order in which documents are put one after another, window by window."""
    n = len(counts)
    unused = np.ones(n, dtype=bool)
    out = np.empty(n, dtype=np.int64)
    placed = at = next_ = 0
    left = n  # documents that the index still holds

    def put(docs: np.ndarray) -> None:
        nonlocal placed, at
        out[placed : placed + len(docs)] = docs
        unused[docs] = False
        placed, at = placed + len(docs), at + int(counts[docs].sum())

    while placed < n:
        while not unused[next_]:
            next_ += 1
        room = -at % window
        if n - placed < SHRUNK * left:
            index, left = index.only(unused), n - placed
        # The document whose rest has begun this window is its seed; an empty window has none.
        near = index.neighbours(out[placed - 1], unused, BEST) if room else np.zeros(0, np.int64)
        if len(near) >= BEST and counts[near].sum() < room:
            near = index.neighbours(out[placed - 1], unused)
        if len(near):
            put(near[: int(np.searchsorted(np.cumsum(counts[near]), room)) + 1])
        else:
            put(np.array([next_]))
    return out


def cuts(total: int, window: int) -> np.ndarray:
    """Where sequences begin in a stream of tokens, and its end: whole windows, then
    powers of two."""
    whole = total // window * window
    rest = [1 << b for b in range(window.bit_length() - 1, -1, -1) if (total - whole) >> b & 1]
    return np.concatenate([np.arange(0, whole, window), whole + np.cumsum([0, *rest])])


def pack_shard(counts: np.ndarray, order: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of a shard: document, start in it, length, sequence, offset in it."""
    ends = np.cumsum(counts[order])
    begins = ends - counts[order]
    bounds = cuts(int(ends[-1]), window)
    at = np.unique(np.concatenate([begins, bounds[:-1]]))
    doc = np.searchsorted(begins, at, "right") - 1
    sequence = np.searchsorted(bounds, at, "right") - 1
    length = np.diff(np.append(at, ends[-1]))
    return order[doc], at - begins[doc], length, sequence, at - bounds[sequence]


_RESULT = "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces of token sequences: key, start, length, doc_tokens, sequence_id, offset, ids.

    ``tokenizer`` is the path of a tokenizer file, read on the driver and sent to the
    workers. A document is the ids of its whole text, without special tokens added, then
    END. Every id is in one piece; ``ids`` holds a piece's as little-endian unsigned 32-bit
    numbers; ``start`` counts its document's ids before it, ``doc_tokens`` all of them.
    Pieces of a sequence follow each other from offset 0 without gaps. A sequence has
    ``window`` (a power of two) ids; a shard's last ones a smaller power of two.

    A null or empty text is END alone. Rows are packed one by one, so repeated rows, also
    with one key, and null keys are documents of their own. No rows give no pieces. Other
    columns are not read. The texts are shuffled once, by ranges of their content: ranges are
    of similar size, as a sample of the rows sets their bounds and rows of one content are
    split by key and place. Sequence ids are made from the range's number and do not
    depend on retries.
    """
    if window & (window - 1):
        raise ValueError("window is not a power of two")
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    name = ("encoder", hashlib.sha256(spec.encode()).hexdigest())
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string(_RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if name not in cache:
            cache[name] = Encoder(sent.value)
        encoder = cache[name]
        sequences = TaskContext.get().partitionId() << 36
        for piece in filled(batches, "text", SHARD_BYTES):
            ids, first, terms, doc = encoder.encode(piece.column("text"))
            counts = np.diff(first)
            order = fill_order(Bm25(terms, doc, len(counts), encoder.order), counts, window)
            row, start, length, sequence, offset = pack_shard(counts, order, window)
            begin = first[row] + start
            run_ = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
            flat = ids[run_].astype("<u4")
            at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * np.int32(4)
            yield batch_of(
                {
                    key: piece.column("key").take(pa.array(row)),
                    "start": start,
                    "length": length,
                    "doc_tokens": counts[row],
                    "sequence_id": sequences + sequence,
                    "offset": offset,
                    "ids": pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(at), pa.py_buffer(flat)]),
                }
            )
            sequences += int(sequence[-1]) + 1
            del piece, ids, terms, doc, begin, run_, flat
            encoder.order = None
        release_memory()

    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return _by_content(own).mapInArrow(run, schema)
