"""Alignment of two tokenizers' tokens, and corpus counts of the token pairs that end together.

For a batch both token lists are tables of (document, start, end, id) in bytes. A
``merge_asof`` in each direction, keyed by document, gives every token start the other
side's covering token; both directions together are all overlaps. Overlapping tokens with
equal ends are a link, and cut the lists into groups.

Both tokenizers always cut between a visible character and a space. So texts are cut
there, and each distinct chunk plays the document of the merge: it is encoded and aligned
once by a worker and remembered by hash. The property is checked when the tokenizers are
loaded; without it whole texts are aligned.

Links leave the first pass packed, and are stored beside their document. Their counts are
added up in slices of the second side's ids, and go back to the documents by broadcast,
in parts of a measured size. A part more is a pass more.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.text import batch_of, mix, pieces, text_bytes, word_hashes, worker_cache
from pairloom.shared import write_table

TEXT_BYTES = 2 << 20  # of text handled at once
KNOWN_CHUNKS = 800_000  # remembered by a worker
NEW_CHUNKS = 40_000  # encoded and aligned at once
LINKS = 1_000_000  # looked at at once
JOINED_BYTES = 1 << 16  # of new chunks encoded in one call
PASS_BYTES = 128 << 20  # of pair counts that are broadcast at once
HELD_PAIRS = 1_000_000  # distinct pairs that a counting task holds
MARK = "▁"
_EVERY = mix(np.arange(256, dtype=np.uint64) + np.uint64(101))  # hash value of each byte
_PAIRS = np.dtype([("pair", "<u8"), ("count", "<i8")])


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file: ids of texts, and the bytes of each id."""

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.encode_special_tokens = True  # their strings are plain text
        back, known = _byte_level(), json.loads(spec)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        cut = known.get("pre_tokenizer") or {}
        self.splits = cut.get("type") == "ByteLevel" and bool(cut.get("use_regex", True)) and not known.get("normalizer")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the added space."""
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A sentence-piece model that adds a space: ids of texts, and the bytes of each id."""

    def __init__(self, spec: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(MARK, " ").encode() for i, name in enumerate(names)
        ]
        # No piece goes on after a space, and the model changes no text (tried on odd ones).
        odd = " a  b\téΩ ﬁ\n c ́"
        whole = b"".join(self.bytes[i] for i in self.model.encode(odd))
        self.splits = not any(MARK in name.lstrip(MARK) for name in names) and whole == (" " + odd).encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the added space."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs (row of a, row of b) of overlapping tokens.

    Both tables have ``doc, start, end`` and are sorted by ``start``; starts and ends
    count over all documents, and a document's tokens follow each other without gaps.
    """
    left = a[["doc", "start"]].assign(a=np.arange(len(a)))
    right = b[["doc", "start"]].assign(b=np.arange(len(b)))
    there = pd.merge_asof(left, right, on="start", by="doc")[["a", "b"]]
    back = pd.merge_asof(right, left, on="start", by="doc")[["a", "b"]]
    return pd.concat([there, back]).dropna().astype(np.int64).drop_duplicates(ignore_index=True)


class Aligner:
    """Chunks that a worker has aligned, by hash: counts, links and the text of the groups."""

    def __init__(self, first: bytes, second: bytes):
        self.a, self.b = ByteLevel(first), Pieces(second)
        self.cuts = self.a.splits and self.b.splits
        self.size_a = np.array([len(x) for x in self.a.bytes])
        self.size_b = np.array([len(x) for x in self.b.bytes])
        self.name_a = np.array([str(i) for i in range(len(self.size_a))], dtype=object)
        self.name_b = np.array([str(i) for i in range(len(self.size_b))], dtype=object)
        self.kind = pair_kind(len(self.size_a), len(self.size_b))
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.where = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros((0, 4), dtype=np.int32)  # tokens of a, of b, links, overlaps
        self.sound = np.zeros(0, dtype=bool)  # both sides' bytes are the chunk's
        self.link_at = np.zeros(1, dtype=np.int64)
        self.links = np.zeros(0, dtype=self.kind)
        self.shown = np.zeros(0, dtype=object)

    def chunks(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each chunk, and whether it ends in a visible character."""
        starts = at[:-1][np.diff(at) > 0]
        visible = _visible(data)
        cut = np.zeros(len(data), dtype=bool)
        if self.cuts:
            cut[1:] = (data[1:] == 32) & visible[:-1]
            cut[at[1:][at[1:] > 0] - 1] = False  # a last space stays with its word
        cut[starts] = True
        begins = np.flatnonzero(cut)
        return begins, visible[np.append(begins[1:], len(data)) - 1]

    def _encoded(self, tokenizer, sizes, texts: list[bytes], plain: np.ndarray):
        """Token ids, the chunk of each, and whether the bytes are right, for many chunks."""
        ids, chunk = [], []
        sound = np.ones(len(texts), dtype=bool)
        parts: list[list[int]] = []
        held = 0
        for i in np.flatnonzero(plain).tolist():
            if not parts or held > JOINED_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(i)
            held += len(texts[i])
        parts += [[i] for i in np.flatnonzero(~plain).tolist()]

        def add(parts: list[list[int]]) -> None:
            joined = [b"".join([texts[i] for i in part]) for part in parts]
            for part, raw, found in zip(parts, joined, tokenizer.encode([j.decode() for j in joined]), strict=True):
                found = np.array(found, dtype=np.int64)
                ends = np.cumsum(sizes[found])
                bounds = np.cumsum([len(texts[i]) for i in part])
                right = len(ends) and ends[-1] == len(raw) and np.isin(bounds, ends).all()
                right = right and b"".join([tokenizer.bytes[i] for i in found.tolist()]) == raw
                if not right and len(part) > 1:  # one of them changes its bytes: look at each
                    add([[i] for i in part])
                elif right:
                    ids.append(found)
                    chunk.append(np.array(part)[np.searchsorted(bounds, ends)])
                else:
                    sound[part[0]] = False

        add(parts)
        none = np.zeros(0, dtype=np.int64)
        ids, chunk = np.concatenate([none, *ids]), np.concatenate([none, *chunk])
        by = np.argsort(chunk, kind="stable")
        return ids[by], chunk[by], sound

    def learn(self, hashes: np.ndarray, texts: list[bytes], plain: np.ndarray) -> None:
        """Encode and align new chunks."""
        n = len(texts)
        lengths = np.array([len(t) for t in texts])
        sides = []
        for tokenizer, sizes in ((self.a, self.size_a), (self.b, self.size_b)):
            ids, chunk, sound = self._encoded(tokenizer, sizes, texts, plain)
            sides.append((ids, chunk, sound, sizes))
        sound = sides[0][2] & sides[1][2]
        begins = np.cumsum(np.where(sound, lengths, 0)) - np.where(sound, lengths, 0)
        tables = []
        for ids, chunk, _, sizes in sides:
            ids, chunk = ids[sound[chunk]], chunk[sound[chunk]]
            ends = np.cumsum(sizes[ids])
            tables.append(pd.DataFrame({"doc": chunk, "start": ends - sizes[ids], "end": ends, "id": ids}))
        a, b = tables
        both = overlaps(a, b)
        row_a, row_b = both["a"].to_numpy(), both["b"].to_numpy()
        equal = a["end"].to_numpy()[row_a] == b["end"].to_numpy()[row_b]
        row_a, row_b = row_a[equal], row_b[equal]
        by = np.argsort(row_a)
        row_a, row_b = row_a[by], row_b[by]
        chunk_a, chunk_b = a["doc"].to_numpy(), b["doc"].to_numpy()
        id_a, id_b = a["id"].to_numpy(), b["id"].to_numpy()
        links = (id_b[row_b] * len(self.size_a) + id_a[row_a]).astype(self.kind)
        per = lambda rows: np.bincount(rows, minlength=n)
        link_chunk = chunk_a[row_a]
        counts = np.stack([per(chunk_a), per(chunk_b), per(link_chunk), per(chunk_a[both["a"].to_numpy()])], 1)
        # The groups' text: a's tokens, then b's, each followed by its sign.
        group_a = np.searchsorted(row_a, np.arange(len(a)))  # links before the token: its group
        group_b = np.searchsorted(np.sort(row_b), np.arange(len(b)))
        last_a, last_b = np.isin(np.arange(len(a)), row_a), np.isin(np.arange(len(b)), row_b)
        token = np.concatenate([self.name_a[id_a] + np.where(last_a, "|", ",").astype(object), self.name_b[id_b] + np.where(last_b, ";", ",").astype(object)])
        group = np.concatenate([group_a, group_b])
        order = np.argsort(group * 2 + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        token, where = token[order].tolist(), np.searchsorted(np.concatenate([chunk_a, chunk_b])[order], np.arange(n + 1)).tolist()
        shown = np.empty(n, dtype=object)
        shown[:] = ["".join(token[where[i] : where[i + 1]]).encode() for i in range(n)]
        base = len(self.sound)
        self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
        self.sound = np.concatenate([self.sound, sound])
        self.link_at = np.concatenate([self.link_at, self.link_at[-1] + np.cumsum(per(link_chunk))])
        self.links = np.concatenate([self.links, links])
        self.shown = np.concatenate([self.shown, shown])
        known = np.concatenate([self.known, hashes])
        where = np.concatenate([self.where, base + np.arange(n)])
        order = np.argsort(known)
        self.known, self.where = known[order], where[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known chunks; -1 for the others."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.where[at], -1)

    def align(self, texts: pa.Array) -> dict:
        """Columns of a run of documents: counts, the groups' digest, links packed."""
        if len(self.known) > KNOWN_CHUNKS or not self.cuts:
            self.clear()
        full = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type))
        full = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", texts.type), full)
        data, at = text_bytes(full)
        n = len(at) - 1
        begins, visible = self.chunks(data, at)
        ends = np.append(begins[1:], len(data)).astype(np.int64)
        hashes = word_hashes(data, begins, ends, _EVERY) if len(begins) else np.zeros(0, np.uint64)
        distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        chunk = self.find(distinct)
        missing = np.flatnonzero(chunk < 0)
        if len(missing):
            raw = data.tobytes()
            for lo in range(0, len(missing), NEW_CHUNKS):
                some = missing[lo : lo + NEW_CHUNKS]
                new = one[some]
                self.learn(distinct[some], [raw[i:j] for i, j in zip(begins[new].tolist(), ends[new].tolist(), strict=True)], visible[new])
            del raw
            chunk = self.find(distinct)
        number = chunk[back]
        doc = np.searchsorted(at, begins, "right") - 1
        sound = np.bincount(doc, weights=~self.sound[number], minlength=n) == 0
        number, doc = number[sound[doc]], doc[sound[doc]]
        first = np.searchsorted(doc, np.arange(n + 1)).tolist()
        counts = np.zeros((n, 4), dtype=np.int64)
        for i in range(4):
            counts[:, i] = np.bincount(doc, weights=self.counts[number, i], minlength=n)
        shown = self.shown[number].tolist()
        digest = [hashlib.sha256(b"".join(shown[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(first[:-1], first[1:], strict=True)]
        size = self.counts[number, 2]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        links = self.links[np.repeat(self.link_at[number], size) + step]
        bounds = np.concatenate([[0], np.cumsum(counts[:, 2])]).astype(np.int64) * self.kind.itemsize
        return {
            "n_a": counts[:, 0],
            "n_b": counts[:, 1],
            "n_groups": counts[:, 2],
            "n_links": counts[:, 2],
            "n_overlaps": counts[:, 3],
            "groups_sha256": pa.array(digest, pa.string()),
            "links": pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(links))]).cast(pa.binary()),
        }


def pair_kind(n_a: int, n_b: int) -> np.dtype:
    """A pair of ids as one number, the second id times the first side's size and the first id."""
    return np.dtype("<u4" if n_a * n_b <= 1 << 32 else "<u8")


def _visible(data: np.ndarray) -> np.ndarray:
    """Bytes that surely end a character that is no white space of any kind.

    ASCII but white space and control characters, and letters of two bytes from U+00C0 on.
    """
    ascii_ = (data > 32) & (data < 127)
    two = np.zeros(len(data), dtype=bool)
    two[1:] = (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    return ascii_ | two


_RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, groups_sha256 string"


def _aligned(docs: DataFrame, specs: list[bytes], key: str, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(tuple(specs))
    name = ("aligner", hashlib.sha256(b"\0".join(specs)).hexdigest())
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string(f"{_RESULT}, links binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if name not in cache:
            cache[name] = Aligner(*sent.value)
        for batch in batches:
            for piece in pieces(batch, text, TEXT_BYTES):
                yield batch_of({key: piece.column(key)} | cache[name].align(piece.column(text)))

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All packed values of a binary column, without a copy, and the number in each row."""
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    at = at[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or not n:
        return np.zeros(0, kind), np.zeros(n, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind), np.diff(at) // kind.itemsize


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with few links, and at least one row."""
    ends = np.cumsum(pc.binary_length(batch.column("links")).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + 4 * LINKS, "right")))
        yield batch.slice(i, j - i)
        i = j


def _added(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    start = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    out = np.empty(len(start), dtype=_PAIRS)
    out["pair"], out["count"] = pairs[start], np.add.reduceat(counts, start) if len(start) else counts
    return out


def _counted(n_slices: int, n_a: int, kind: np.dtype):
    """Partial counts of a task's links, packed by slice of the second side's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=_PAIRS)

        def leave() -> pa.RecordBatch:
            slices = held["pair"] // np.uint64(n_a) % np.uint64(n_slices)
            order = np.argsort(slices, kind="stable")
            ends = np.searchsorted(slices[order], np.arange(n_slices + 1))
            some = np.flatnonzero(np.diff(ends))
            rows = [held[order[ends[s] : ends[s + 1]]].tobytes() for s in some]
            return batch_of({"slice": some.astype(np.int32), "rows": pa.array(rows, pa.binary())})

        for batch in batches:
            links, _ = _flat(batch.column("links"), kind)
            for lo in range(0, len(links), LINKS):
                pairs, counts = np.unique(links[lo : lo + LINKS], return_counts=True)
                held = _added(np.concatenate([held["pair"], pairs]), np.concatenate([held["count"], counts]))
                if len(held) >= HELD_PAIRS:
                    yield leave()
                    held = held[:0]
        if len(held):
            yield leave()

    return run


def _totals(n_a: int):
    """Counts of one slice; the highest of each second id is stored as a negative number."""

    def run(group: pa.Table) -> pa.Table:
        rows, _ = _flat(group.column("rows").combine_chunks(), _PAIRS)
        out = _added(rows["pair"], rows["count"])
        second = out["pair"] // np.uint64(n_a)
        start = np.flatnonzero(np.append(True, second[1:] != second[:-1]))
        best = np.repeat(np.maximum.reduceat(out["count"], start), np.diff(np.append(start, len(out))))
        out["count"] = np.where(out["count"] == best, -out["count"], out["count"])
        return pa.table({"slice": group.column("slice")[:1], "n_bytes": pa.array([out.nbytes]), "rows": pa.array([out.tobytes()], pa.binary())})

    return run


def _parts(totals: DataFrame, limit: int) -> list[list[int]]:
    """Slices whose counts go out together, by their measured sizes."""
    parts: list[list[int]] = []
    size = limit + 1
    for r in totals.select("slice", "n_bytes").orderBy("slice").collect():
        if size + r.n_bytes > limit:
            parts.append([])
            size = 0
        parts[-1].append(r.slice)
        size += r.n_bytes
    return parts


def _with_counts(rows: DataFrame, totals: DataFrame, part: list[int], kind: np.dtype) -> DataFrame:
    """Add the counts of the pairs of some slices to n_best and count_sum."""
    found = totals.filter(F.col("slice").isin(part)).select("rows").toArrow()
    table, _ = _flat(found.column("rows").combine_chunks(), _PAIRS)
    table = table[np.argsort(table["pair"])]
    sent = rows.sparkSession.sparkContext.broadcast((table["pair"].astype(kind), table["count"].copy()))
    del found, table
    names = rows.columns

    def looked_up(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many best pairs, and what sum of counts, lie before each link and at the end."""
        pairs, counts = sent.value
        best, total = np.zeros(len(links) + 1, dtype=np.int64), np.zeros(len(links) + 1, dtype=np.int64)
        for lo in range(0, len(links), LINKS):
            own = links[lo : lo + LINKS]
            at = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
            count = np.where(pairs[at] == own, counts[at], 0)
            best[lo + 1 : lo + 1 + len(own)] = count < 0
            total[lo + 1 : lo + 1 + len(own)] = np.abs(count)
        return np.cumsum(best), np.cumsum(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                links, size = _flat(batch.column("links"), kind)
                ends = np.concatenate([[0], np.cumsum(size)])
                out = {c: batch.column(c) for c in names}
                for c, sums in zip(("n_best", "count_sum"), looked_up(links), strict=True):
                    out[c] = batch.column(c).to_numpy() + sums[ends[1:]] - sums[ends[:-1]]
                yield batch_of(out)

    return rows.mapInArrow(run, rows.schema)


def align_tokens(
    docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256.

    ``first`` is the path of a byte-level BPE file, applied to a space and the whole text,
    ``second`` that of a sentence-piece model that adds this space. Special tokens' strings
    are plain text. Places where tokens of both end cut them into groups; two tokens that
    end together are a link. A pair's count is the number of its links in all documents;
    ``count_sum`` adds up the counts of a document's links, and ``n_best`` counts those
    whose pair has the highest count of its second id. ``n_overlaps`` counts the pairs of
    overlapping tokens. ``groups_sha256`` is the digest of `a1,a2|b1;a3|b2,b3`.

    A null or empty text, and one that either tokenizer does not give back byte by byte,
    has no tokens: zeros and an empty digest. Every row is a document of its own, also
    repeated ones and those with a null key. No rows give no rows. Other columns are not
    read, so their names do not matter.

    Links are stored with 4 bytes each, or 8 for large vocabularies. Pair counts are broadcast in parts of
    ``pass_bytes``; their number is bounded by the vocabularies and measured here.
    """
    specs = []
    for path in (first, second):
        with open(path, "rb") as f:
            specs.append(f.read())
    n_a = len(ByteLevel(specs[0]).bytes)
    kind = pair_kind(n_a, len(Pieces(specs[1]).bytes))
    stored = write_table(_aligned(docs, specs, key, text), "aligned")
    n_slices = max(64, stored.rdd.getNumPartitions())
    partial = stored.select("links").mapInArrow(_counted(n_slices, n_a, kind), "slice int, rows binary")
    totals = write_table(partial.groupBy("slice").applyInArrow(_totals(n_a), "slice int, n_bytes bigint, rows binary"), "pair-counts")
    rows = stored.withColumns({"n_best": F.lit(0).cast("bigint"), "count_sum": F.lit(0).cast("bigint")})
    parts = _parts(totals, pass_bytes)
    for i, part in enumerate(parts):
        rows = _with_counts(rows, totals, part, kind)
        if i + 1 < len(parts):
            rows = write_table(rows, "aligned")
    names = [n.split()[0] for n in _RESULT.split(", ")]
    return rows.select(f"`{key}`", *names[:-1], "n_best", "count_sum", names[-1])
