"""Similarity join of word-shingle sets by PartEnum signatures.

Two sets of sizes s and t with a Jaccard similarity of at least g differ in at most
``(1 - g) / (1 + g) * (s + t)`` elements, and their sizes lie in the same or in
neighbouring bands. For each band the feature domain is cut into groups of three
partitions, so many groups that one of them holds at most one of the differing elements.
Two of the three partitions of that group are then equal: every subset of two partitions
is enumerated as a signature, and similar sets share one, whatever they are.

Sets with a common signature are candidates. A signature's members are compared with one
of them by exact bounds from parity bitmaps, and where they still lie in different
components, with each other in blocks; a block only returns the pairs that join two
components. So near components arise that hold every similar pair. In each of them the
whole sets are compared, block against block, in the task that holds them: it returns one
row for each set, with the number of its links and the set it hangs together with. No step
writes out the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.text import SPACED, batch_of, list_of, mix, pieces, release_memory, shingles_of, with_columns, words_of
from pairloom.operators.skew import salted_join
from pairloom.shared import fresh_path, scratch, write_table

GROUP, DIFFERING = 3, 1  # partitions in a group, and differing elements it may hold
BITS = 2048  # of a parity bitmap at least; a larger set has as many as elements, rounded up to a power of two
BLOCK = 2048  # members of one signature whose bitmaps are compared in one task
SETS = 1024  # of a near component that are compared with as many others in one task
SHINGLES = 1_000_000  # of such a block, on average; a set moves once for each block of its component
CENTERS = 32 << 20  # bytes of the first sets of large components, which are broadcast up to this size
SMALL = 1_000_000  # shingles of small components that one task takes together
NEAR_ROWS = 2000  # pairs whose bitmaps are compared at once
COLUMNS, POSTINGS = 4096, 64  # shingles multiplied together; pairs up to which a shingle's are listed
FLUSH = 500_000  # signatures that leave a task together; a worker takes some 100 bytes for each
SIGNED_BYTES = 1 << 20  # of text that is signed at once: signatures take many times the text
BROADCAST_ROWS = 2_000_000  # of ids (16 bytes each) that may be broadcast


class Bands:
    """Size bands and the most elements in which similar sets of a band can differ."""

    def __init__(self, top: int, num: int, den: int):
        low, high = 1, []
        while low <= top:
            high.append(low * den // num)
            low = high[-1] + 1
        high.append(low * den // num)
        high.append((high[-1] + 1) * den // num)
        self.high = np.array(high, dtype=np.int64)
        differ = 2 * self.high * (den - num) // (den + num)
        self.groups = -(-(differ + 1) // (DIFFERING + 1))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted in each, and the first of each text (one more at the end)."""
    hashes, first = words_of(texts, SPACED)
    found, row = shingles_of(hashes, first, words)
    order = np.lexsort([found, row])
    found, row = found[order], row[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    found, row = found[new], row[new]
    return found, np.searchsorted(row, np.arange(len(texts) + 1))


def set_ids(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set; equal sets have equal numbers."""
    sums = np.zeros(len(found) + 1, dtype=np.uint64)
    np.cumsum(mix(found + np.uint64(1)), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def signatures(found: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of all sets, and the set of each. Empty sets have none."""
    size = np.diff(first)
    bands = Bands(int(size.max(initial=1)), num, den)
    rows = np.flatnonzero(size > 0)
    row = np.repeat(np.arange(len(size)), size)
    cell_hash, element = mix(found ^ np.uint64(0x5851F42D4C957F2D)), mix(found + np.uint64(0x14057B7EF767814F))
    out, of = [], []
    for step in (0, 1):  # a set takes part in its own band and in the next one
        band = np.searchsorted(bands.high, size) + step
        groups = bands.groups[band]
        at = np.concatenate([[0], np.cumsum(groups * GROUP)])
        cell = (cell_hash % (groups[row] * GROUP).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(at[-1], dtype=np.uint64)
        np.add.at(sums, at[row] + cell, element)
        owner = np.repeat(rows, groups[rows])
        n = np.arange(len(owner)) - np.repeat(np.cumsum(groups[rows]) - groups[rows], groups[rows])
        base = at[owner] + n * GROUP
        place = mix((band[owner] << 32 | n).astype(np.uint64))
        for left in range(GROUP):  # each subset leaves DIFFERING = 1 partition out
            key = mix(place + np.uint64(left + 1))
            for part in range(GROUP):
                if part != left:
                    key = mix(key * np.uint64(3) + sums[base + part])
            out.append(key)
            of.append(owner)
    return np.concatenate(out), np.concatenate(of)


def bitmaps(found: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Parity bitmap of each set: two sets' bitmaps of one length differ in no more bits than
    the sets differ in elements. Folded by exclusive or, a bitmap is that of a shorter length."""
    size = np.diff(first)
    bits = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(bits >> 6)])
    row = np.repeat(np.arange(len(size)), size)
    bit = mix(found + np.uint64(77)) & (bits[row] - 1).astype(np.uint64)
    out = np.zeros(at[-1], dtype=np.uint64)
    np.bitwise_xor.at(out, at[row] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return [out[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


class Bitmaps:
    """Bitmaps of many sets, to be compared pair by pair at the shorter one's length."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(r) for r in raw], dtype=np.int64)
        self.place, self.table = {}, {}
        for width in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width >= width)
            table = np.empty((len(rows), width // 8), dtype=np.uint64)
            for own in np.unique(self.width[rows]).tolist():
                some = np.flatnonzero(self.width[rows] == own)
                whole = np.frombuffer(b"".join([raw[i] for i in rows[some].tolist()]), np.uint64)
                table[some] = np.bitwise_xor.reduce(whole.reshape(len(some), own // width, width // 8), axis=1)
            place = np.zeros(len(raw), dtype=np.int64)
            place[rows] = np.arange(len(rows))
            self.place[width], self.table[width] = place, table

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the sets i differ from the sets j."""
        out = np.zeros(len(i), dtype=np.int64)
        width = np.minimum(self.width[i], self.width[j])
        for w in np.unique(width).tolist():
            some = np.flatnonzero(width == w)
            place, table = self.place[w], self.table[w]
            out[some] = np.bitwise_count(table[place[i[some]]] ^ table[place[j[some]]]).sum(1, dtype=np.int64)
        return out


SIGNATURE_BYTES = 5  # of a signature within its slice; sets that only seem to share one are compared in vain


def _packed(batches, parts, n_slices: int) -> Iterator[pa.RecordBatch]:
    """Signatures by slice: one row for each slice and flush of a task.

    ``parts`` yields (signatures, set of each, set ids) for a batch. A slice's row holds
    set ids, the number of signatures of each, and the signatures without their lowest bytes.
    """
    held: list[tuple] = []

    def leave() -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *[len(h[2]) for h in held]])
        key, ids = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
        of = np.concatenate([h[1] + n for h, n in zip(held, base[:-1], strict=True)])
        place = (key % np.uint64(n_slices)).astype(np.int64) * len(ids) + of
        order = np.argsort(place, kind="stable")
        place, key = place[order], np.ascontiguousarray(key[order], "<u8")
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        count = np.diff(np.append(start, len(place))).astype("<u4")
        own = ids[place[start] % len(ids)].astype("<u8")
        slices = place[start] // len(ids)
        short = key.view(np.uint8).reshape(-1, 8)[:, 8 - SIGNATURE_BYTES :]
        ends = np.searchsorted(slices, np.arange(n_slices + 1))
        some = np.flatnonzero(np.diff(ends))
        bounds = np.append(start, len(place))
        yield batch_of(
            {
                "slice": some.astype(np.int32),
                "ids": pa.array([own[ends[s] : ends[s + 1]].tobytes() for s in some], pa.binary()),
                "counts": pa.array([count[ends[s] : ends[s + 1]].tobytes() for s in some], pa.binary()),
                "signatures": pa.array([short[bounds[ends[s]] : bounds[ends[s + 1]]].tobytes() for s in some], pa.binary()),
            }
        )

    for batch in batches:
        for part in parts(batch):
            if len(part[0]):
                held.append(part)
            del part
            if sum(len(h[0]) for h in held) >= FLUSH:
                yield from leave()
                held.clear()
                release_memory()
    if held:
        yield from leave()
        held.clear()
        release_memory()


_PACKED = "slice int, ids binary, counts binary, signatures binary"


def _distinct(columns: np.ndarray) -> np.ndarray:
    order = np.lexsort([columns[:, i] for i in range(columns.shape[1])][::-1])
    columns = columns[order]
    new = np.ones(len(columns), dtype=bool)
    new[1:] = (columns[1:] != columns[:-1]).any(1)
    return columns[new]


def _groups(group: pa.Table) -> pa.Table:
    """The sets of each signature of a slice: the smallest with each other one, equal groups once.

    ``gid`` names a group of three or more; pairs have 0.
    """
    join = lambda c: b"".join(x.as_py() for x in group.column(c))
    ids, counts = np.frombuffer(join("ids"), "<u8"), np.frombuffer(join("counts"), "<u4")
    short = np.frombuffer(join("signatures"), np.uint8).reshape(-1, SIGNATURE_BYTES)
    key = np.zeros((len(short), 8), dtype=np.uint8)
    key[:, 8 - SIGNATURE_BYTES :] = short
    rows = _distinct(np.stack([key.view("<u8").ravel(), np.repeat(ids, counts)], 1))
    start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])) if len(rows) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(rows)))
    gid = mix(np.add.reduceat(mix(rows[:, 1] + np.uint64(5)), start) + size.astype(np.uint64)) if len(rows) else np.zeros(0, np.uint64)
    _, one = np.unique(gid, return_index=True)
    once = np.zeros(len(start), dtype=bool)
    once[one] = True
    once &= size > 1
    gid = np.where(size > 2, gid | np.uint64(1), 0)
    take = np.repeat(once, size)
    take[start] = False
    first = np.repeat(rows[start, 1], size)[take] if len(rows) else np.zeros(0, np.uint64)
    columns = {"gid": np.repeat(gid, size)[take], "a": first, "b": rows[take, 1] if len(rows) else first}
    made = pa.table({c: pa.array(x.astype(np.uint64).view(np.int64)) for c, x in columns.items()})
    del ids, counts, short, key, rows, start, size, gid, one, once, take, first, columns
    release_memory()
    return made


def _near_forest(num: int, den: int):
    """Pairs of one key that their sizes and bitmaps allow, as far as they join different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            held = table.slice(cut)
            yield from compared(table.slice(0, cut))
        if held is not None:
            yield from compared(held)
        release_memory()

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        key, one, two, block, set_id, label, size = (
            table.column(c).to_numpy() for c in ("key", "one", "two", "block", "set_id", "label", "n")
        )
        bits = Bitmaps(table.column("bitmap").to_pylist())
        names, own = np.unique(label, return_inverse=True)
        up = np.arange(len(names))  # the components joined so far, as a forest over labels

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        active = np.arange(len(key))
        step = 1
        while True:
            active = active[active + step < len(key)]
            active = active[key[active] == key[active + step]]
            if not len(active):
                return
            for at in range(0, len(active), 1 << 14):
                i = active[at : at + (1 << 14)]
                j = i + step
                while (up[up] != up).any():
                    up[:] = up[up]
                ok = (up[own[i]] != up[own[j]]) & ((one[i] == two[i]) | (block[i] != block[j]))
                ok &= np.minimum(size[i], size[j]) * den >= np.maximum(size[i], size[j]) * num
                i, j = i[ok], j[ok]
                keep = bits.differing(i, j) <= (size[i] + size[j]) * (den - num) // (den + num)
                joined = []
                for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
                    a, b = root(own[x]), root(own[y])
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        joined.append((x, y))
                if joined:
                    x, y = set_id[[p[0] for p in joined]], set_id[[p[1] for p in joined]]
                    yield batch_of({"a": np.minimum(x, y), "b": np.maximum(x, y)})
            step += 1

    return run


def _common(row_a: np.ndarray, a: np.ndarray, n_a: int, row_b: np.ndarray, b: np.ndarray, n_b: int) -> np.ndarray:
    """Sizes of the intersections of every set of one side with every set of the other.

    ``a`` and ``b`` are elements, ``row_a`` and ``row_b`` their sets. Elements of many pairs
    are counted by products of 0-1 matrices, the others pair by pair.
    """
    distinct, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = back[: len(a)], back[len(a) :]
    held_a, held_b = (np.bincount(x, minlength=len(distinct)) for x in (a, b))
    out = np.zeros((n_a, n_b), dtype=np.int64)
    many = held_a * held_b > POSTINGS
    column = np.where(many, np.cumsum(many) - 1, -1)
    for lo in range(0, int(many.sum()), COLUMNS):
        sides = []
        for row, x, n in ((row_a, a, n_a), (row_b, b, n_b)):
            at = column[x] - lo
            some = (at >= 0) & (at < COLUMNS) & many[x]
            side = np.zeros((n, COLUMNS), dtype=np.float32)
            side[row[some], at[some]] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    sorted_b = row_b[np.argsort(b, kind="stable")]
    start_b = np.cumsum(held_b) - held_b
    few = np.flatnonzero(~many[a] & (held_b[a] > 0))
    for lo in range(0, len(few), 1 << 16):
        i = few[lo : lo + (1 << 16)]
        times = held_b[a[i]]
        run = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        other = sorted_b[np.repeat(start_b[a[i]], times) + run]
        out += np.bincount(np.repeat(row_a[i], times) * n_b + other, minlength=n_a * n_b).reshape(n_a, n_b)
    return out


def _differences(found: np.ndarray, first: np.ndarray, label: np.ndarray, centers: dict[int, np.ndarray]):
    """Each set as it differs from its component's center, or whole if it has none.

    Returns the elements in which they differ, their number for each set, how many of them
    only the center has, and the center's size (0: none). For two sets with one center,
    the common elements are size - removed - removed' + common differences, because
    elements that one set lacks and elements that it adds are never the same.
    """
    n = len(first) - 1
    removed, base = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    parts = [found[first[i] : first[i + 1]] for i in range(n)]
    for name in np.unique(label):
        center = centers.get(int(name))
        if center is None:
            continue
        for i in np.flatnonzero(label == name):
            at = np.minimum(np.searchsorted(center, parts[i]), len(center) - 1)
            held = center[at] == parts[i]
            lacks = np.ones(len(center), dtype=bool)
            lacks[at[held]] = False
            removed[i], base[i] = lacks.sum(), len(center)
            parts[i] = np.concatenate([center[lacks], parts[i][~held]])
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.array([len(x) for x in parts], dtype=np.int64), removed, base


def _side(group: pa.Table, take: np.ndarray) -> tuple:
    """Ids, sizes, removed elements and center's size of some rows' sets, each set once, and
    the differing elements with the set of each."""
    ids, first = np.unique(group.column("set_id").to_numpy()[take], return_index=True)
    rows = group.take(pa.array(take[first]))
    lists = rows.column("shingles").combine_chunks()
    size, removed, base = (rows.column(c).to_numpy() for c in ("n", "removed", "base"))
    return ids, size, removed, base, np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()


def _linked(a: tuple, b: tuple, num: int, den: int) -> np.ndarray:
    """Which sets of one side are similar to which of the other."""
    if len(a[0]) == len(b[0]) == 1:
        common = np.array([[len(np.intersect1d(a[5], b[5], assume_unique=True))]])
    else:
        common = _common(a[4], a[5], len(a[0]), b[4], b[5], len(b[0]))
    common = common + a[3][:, None] - a[2][:, None] - b[2][None, :]
    return common * den >= (a[1][:, None] + b[1][None, :] - common) * num


def _hanging(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the sets of both sides the least set that links lead to; the second side counts on."""
    n, m = linked.shape
    x, y = np.arange(n), n + np.arange(m)
    while True:
        new_y = np.minimum(y, np.where(linked, x[:, None], n + m).min(0, initial=n + m))
        new_x = np.minimum(x, np.where(linked, new_y[None, :], n + m).min(1, initial=n + m))
        if (new_x == x).all() and (new_y == y).all():
            return x, y
        x, y = new_x, new_y


def _exact(num: int, den: int):
    """Links of each set within a block of a near component or between two blocks.

    A group holds two blocks of one component, or many small components. A row for each
    set: how many sets of the other side it is similar to, and the set it hangs together with.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        label, block = (group.column(c).to_numpy() for c in ("label", "block"))
        one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
        order = np.argsort(label, kind="stable")
        start = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
        out = []
        for own in np.split(order, start[1:]):
            if one == two:
                a = b = _side(group, own)
                linked = _linked(a, b, num, den) if len(a[0]) > 1 else np.zeros((len(a[0]), len(a[0])), dtype=bool)
                np.fill_diagonal(linked, False)
                ids, n_links, root = a[0], linked.sum(1), a[0][_hanging(linked | np.eye(len(a[0]), dtype=bool))[0]]
            else:
                a, b = (_side(group, own[block[own] == x]) for x in (one, two))
                linked = _linked(a, b, num, den) if len(a[0]) and len(b[0]) else np.zeros((len(a[0]), len(b[0])), dtype=bool)
                ids = np.concatenate([a[0], b[0]])
                n_links, root = np.concatenate([linked.sum(1), linked.sum(0)]), ids[np.concatenate(_hanging(linked))]
            out.append((ids, root, n_links))
        ids, root, n_links = (np.concatenate(c) for c in zip(*out, strict=True))
        del out, a, b, linked
        release_memory()
        return pa.table({"set_id": ids, "root": root, "n_links": n_links.astype(np.int64)})

    return run


class SimilarSets:
    """The join's stored tables: ``members`` (every row's key, n_shingles and set), ``links``
    (pairs of similar sets, enough of them to connect every class) and ``counts`` (set_id,
    n_links: how many other sets each set of a near component is similar to)."""

    def __init__(self, docs: DataFrame, key: str, text: str, words: int, threshold: tuple[int, int]):
        self.num, self.den = threshold
        self.words = words
        # A row is found again by this hash, whatever its key.
        own = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row_hash")
        self.rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), own)
        self.n_slices = max(8, 2 * docs.rdd.getNumPartitions())
        self.members = write_table(with_columns(self.rows, "text", "n bigint, set_id bigint", self._sizes(), ["key", "row_hash"]), "sets")
        groups = self._signed().groupBy("slice").applyInArrow(_groups, "gid bigint, a bigint, b bigint")
        groups = write_table(groups.distinct(), "groups")
        stars = write_table(groups.select("a", "b").distinct(), "stars")
        self.bits = self._bits(stars)
        edges = write_table(self._near(stars), "near")
        labels = components(edges)
        more = write_table(self._crossing(groups, labels), "crossing")
        if not more.isEmpty():
            labels = components(edges.unionByName(more))
        exact = write_table(self._exact(labels), "exact")
        self.links = exact.filter("root <> set_id").select(F.col("root").alias("a"), F.col("set_id").alias("b"))
        self.counts = exact.groupBy("set_id").agg(F.sum("n_links").alias("n_links"))

    def _sizes(self):
        words = self.words

        def make(piece: pa.RecordBatch) -> dict:
            found, first = shingle_sets(piece.column("text"), words)
            return {"n": np.diff(first), "set_id": set_ids(found, first)}

        return make

    def _signed(self) -> DataFrame:
        words, num, den, n_slices = self.words, self.num, self.den, self.n_slices

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            signed = np.zeros(0, dtype=np.uint64)  # sets that this task has signed

            def parts(batch):
                nonlocal signed
                for piece in pieces(batch, "text", SIGNED_BYTES):
                    found, first = shingle_sets(piece.column("text"), words)
                    ids, at = np.unique(set_ids(found, first).view(np.uint64), return_index=True)
                    new = at[~np.isin(ids, signed)]
                    size = np.diff(first)[new]
                    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                    own = found[np.repeat(first[new], size) + step]
                    bounds = np.concatenate([[0], np.cumsum(size)])
                    signed = np.concatenate([signed, set_ids(found, first).view(np.uint64)[new]])
                    yield *signatures(own, bounds, num, den), signed[len(signed) - len(new) :]

            yield from _packed(batches, parts, n_slices)

        return self.rows.select("text").mapInArrow(run, _PACKED)

    def _one_row(self) -> DataFrame:
        """set_id, row_hash and n of every set that is not empty, from one of its rows."""
        return self.members.filter("n > 0").groupBy("set_id").agg(F.min("row_hash").alias("row_hash"), F.first("n").alias("n"))

    def _texts(self, chosen: DataFrame) -> DataFrame:
        """The rows of a stored table with ``row_hash``, with their texts.

        Its rows have numbers only, and up to BROADCAST_ROWS of them are broadcast.
        """
        small = chosen.count() <= BROADCAST_ROWS
        return self.rows.select("row_hash", "text").join(F.broadcast(chosen) if small else chosen, "row_hash").drop("row_hash")

    def _bits(self, stars: DataFrame) -> DataFrame:
        """set_id, n and bitmap of every set with a common signature."""
        ids = stars.select(F.col("a").alias("set_id")).unionByName(stars.select(F.col("b").alias("set_id"))).distinct()
        chosen = write_table(self._one_row().join(ids, "set_id", "left_semi").select("set_id", "row_hash"), "involved")
        words = self.words

        def make(piece: pa.RecordBatch) -> dict:
            found, first = shingle_sets(piece.column("text"), words)
            bits = bitmaps(found, first)
            return {"own": set_ids(found, first), "n": np.diff(first), "bitmap": pa.array([b.tobytes() for b in bits], pa.binary())}

        made = with_columns(self._texts(chosen), "text", "own bigint, n bigint, bitmap binary", make, ["set_id"])
        bits = write_table(made.filter("own = set_id").drop("own"), "bitmaps")
        n, different = bits.agg(F.count(F.lit(1)), F.count_distinct("set_id")).first()
        return bits if n == different else write_table(bits.dropDuplicates(["set_id"]), "bitmaps")  # repeated rows

    def _near(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and bitmaps allow."""
        num, den = self.num, self.den

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, NEAR_ROWS):
                    part = batch.slice(at, NEAR_ROWS)
                    m, n = part.column("n_a").to_numpy(), part.column("n_b").to_numpy()
                    part = part.filter(pa.array(np.minimum(m, n) * den >= np.maximum(m, n) * num))
                    if not part.num_rows:
                        continue
                    m, n = part.column("n_a").to_numpy(), part.column("n_b").to_numpy()
                    own = Bitmaps(part.column("bits_a").to_pylist() + part.column("bits_b").to_pylist())
                    differ = own.differing(np.arange(len(m)), len(m) + np.arange(len(m)))
                    yield part.select(["a", "b"]).filter(pa.array(differ <= (m + n) * (den - num) // (den + num)))
            release_memory()

        side = lambda x: self.bits.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"bits_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(near, "a bigint, b bigint")

    def _crossing(self, groups: DataFrame, labels: DataFrame) -> DataFrame:
        """Near pairs that join components, from the groups that hold several of them."""
        named = groups.filter("gid <> 0")
        rows = named.select("gid", F.col("b").alias("set_id")).unionByName(named.select("gid", F.col("a").alias("set_id")).distinct())
        known = rows.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        known = write_table(known, "group-members")
        several = known.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
        several = several.filter("lo <> hi").select("gid", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        # A group of more than BLOCK members is dealt to blocks; every two blocks meet in one task.
        dealt = (
            known.join(write_table(several, "open-groups"), "gid")
            .withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                F.xxhash64("gid", F.least("block", "other"), F.greatest("block", "other")).alias("key"),
                F.least("block", "other").alias("one"),
                F.greatest("block", "other").alias("two"),
                "block",
                "set_id",
                "label",
            )
        )
        sorted_ = dealt.join(self.bits, "set_id").repartition("key").sortWithinPartitions("key", "set_id")
        return sorted_.mapInArrow(_near_forest(self.num, self.den), "a bigint, b bigint").distinct()

    def _centers(self, near: DataFrame, chosen: DataFrame) -> Broadcast:
        """The sorted first set of each component of several blocks, by label.

        Its sets move once for each block, so only as they differ from this one. There are few
        such components; should their first sets exceed CENTERS bytes, all sets move whole.
        """
        context = near.sparkSession.sparkContext
        large = write_table(chosen.filter("blocks > 1 AND set_id = label"), "centers")
        held = near.join(large.select("set_id"), "set_id", "left_semi").agg(F.sum("n")).first()[0] or 0
        if not 0 < 8 * held <= CENTERS:
            return context.broadcast({})
        words = self.words

        def make(piece: pa.RecordBatch) -> dict:
            found, first = shingle_sets(piece.column("text"), words)
            return {"own": set_ids(found, first), "shingles": list_of(found.view(np.int64), np.diff(first))}

        made = with_columns(self._texts(large), "text", "own bigint, shingles array<bigint>", make, ["set_id"])
        rows = made.filter("own = set_id").dropDuplicates(["set_id"]).toArrow()
        sets = [x.values.to_numpy().view(np.uint64) for x in rows.column("shingles")]
        return context.broadcast(dict(zip(rows.column("set_id").to_pylist(), sets, strict=True)))

    def _exact(self, labels: DataFrame) -> DataFrame:
        """set_id, root, n_links of the sets of near components, from their whole sets.

        The sets of a component are dealt to blocks, and every two blocks meet in one task.
        """
        near = labels.withColumnRenamed("node", "set_id").join(self._one_row(), "set_id")
        near = write_table(near, "near-sets")
        sizes = near.groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("total"))
        blocks = F.ceil(F.greatest(F.col("count") / SETS, F.col("total") / SHINGLES)).cast("int")
        sizes = write_table(sizes.select("label", "total", F.least(blocks, "count").cast("int").alias("blocks")), "component-sizes")
        tasks = sizes.filter("blocks = 1").agg(F.sum("total")).first()[0] or 0
        tasks = tasks // SMALL + 1
        chosen = write_table(near.join(sizes, "label").select("row_hash", "set_id", "label", "blocks"), "chosen-sets")
        words, sent = self.words, self._centers(near, chosen)

        def make(piece: pa.RecordBatch) -> dict:
            found, first = shingle_sets(piece.column("text"), words)
            other, size, removed, base = _differences(found, first, piece.column("label").to_numpy(), sent.value)
            return {
                "own": set_ids(found, first),
                "n": np.diff(first),
                "shingles": list_of(other.view(np.int64), size),
                "removed": removed,
                "base": base,
            }

        result = "own bigint, n bigint, shingles array<bigint>, removed bigint, base bigint"
        made = with_columns(self._texts(chosen), "text", result, make, ["set_id", "label", "blocks"])
        dealt = (
            made.filter("own = set_id")
            .withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
            .withColumn("together", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(tasks))).otherwise(F.col("label")))
            .withColumn("small", F.col("blocks") == 1)
            .select("small", "together", "one", "two", "block", "label", "set_id", "n", "shingles", "removed", "base")
        )
        return dealt.groupBy("small", "together", "one", "two").applyInArrow(
            _exact(self.num, self.den), "set_id bigint, root bigint, n_links bigint"
        )


def _named(found: SimilarSets, labels: DataFrame) -> DataFrame:
    """set_id, label, component_id of every set that is not empty."""
    by_set = found.members.filter("n > 0").groupBy("set_id").agg(F.min("key").alias("first"))
    named = by_set.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "label", F.coalesce("label", "set_id")
    )
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return named.join(ids, "label").select("set_id", "label", "component_id")


def similar_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    threshold: tuple[int, int] = (80, 100),
) -> DataFrame:
    """``key``, n_shingles, component_id, n_links: near-duplicate classes of all rows.

    A row's set has the distinct ``words``-word shingles of its whole text (lower-case
    A-Z, words are runs without ASCII white space); a shorter text is one shingle. Two
    rows are linked when ``den * intersection >= num * union`` for ``threshold`` (num,
    den). component_id is the smallest key that links lead to; n_links counts all
    other sets that are similar to a row's.

    A null or empty text has the empty set and is linked with nothing: its component is
    its own key. Rows with equal sets are linked, whatever their keys. A row with a null
    key is linked like any other; a component of null keys only has a null id. Repeated
    rows each return. Empty tables give no rows. Other columns are not read.
    """
    found = SimilarSets(docs, key, text, words, threshold)
    labels = components(found.links, "classes")
    classes = write_table(
        _named(found, labels)
        .join(found.counts, "set_id", "left")
        .select("set_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "classes",
    )
    full = salted_join(found.members.filter("n > 0"), classes, "set_id", "key", "inner")
    empty = found.members.filter("n = 0").select("key", "n", F.col("key").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return full.select("key", "n", "component_id", "n_links").unionByName(empty).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links"
    )


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: tuple[int, int] = (80, 100)
) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest key, null keys last.

    Of the rows that share this key, repeated rows and different texts of the class alike,
    the first stored one stays. Rows with an empty set (null or empty texts) all stay.
    Only the keys that go, and the rows whose key is null or shared, are stored; the join's
    own tables are deleted at the end.
    """
    spark = docs.sparkSession
    gone_path, rows_path, kept_path = (fresh_path(spark, name) for name in ("copies", "unclear-rows", "kept-rows"))
    with scratch(spark):
        found = SimilarSets(docs, key, text, words, threshold)
        classes = write_table(_named(found, components(found.links, "classes")), "classes")
        shared = found.members.groupBy("key").count().filter("key IS NULL OR count > 1").select(F.col("key").alias("shared"))
        shared = write_table(shared, "shared-keys")
        full = salted_join(found.members.filter("n > 0"), classes, "set_id", "key", "inner")
        gone = full.filter("component_id <> key").select("key").unionByName(shared.select(F.col("shared").alias("key")))
        gone.filter("key IS NOT NULL").distinct().write.parquet(gone_path)
        n_shared = shared.count()
        if n_shared:
            small = F.broadcast(shared) if n_shared <= BROADCAST_ROWS else shared
            unclear = docs.join(small, docs[f"`{key}`"].eqNullSafe(small["shared"]), "left_semi")
            whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
            unclear.select(whole.alias("doc"), F.monotonically_increasing_id().alias("row")).write.parquet(rows_path)
            stored = spark.read.parquet(rows_path)
            own = stored.select("row", F.col("doc").getField(key).alias("key"), F.col("doc").getField(text).alias("text"))
            sets = write_table(with_columns(own, "text", "n bigint, set_id bigint", found._sizes(), ["row", "key"]), "unclear-sets")
            owned = salted_join(sets.filter("n > 0"), classes, "set_id", "row", "inner")
            first = owned.filter("key <=> component_id").groupBy("label").agg(F.min("row").alias("row"))
            sets.filter("n = 0").select("row").unionByName(first.select("row")).write.parquet(kept_path)
    gone = spark.read.parquet(gone_path).withColumnRenamed("key", key)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    clear = docs.filter(F.col(f"`{key}`").isNotNull()).join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if not n_shared:
        return clear
    kept = spark.read.parquet(rows_path).join(spark.read.parquet(kept_path), "row", "left_semi")
    return clear.unionByName(kept.select("doc.*"))
