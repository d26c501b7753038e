"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Distinct vectors are dealt to shards by hash. A shard's graph has a layer of all its
vectors and thinner layers above, each a fraction of the one below, with a bounded
number of links per vector and layer kept as flat arrays. A query walks down from the top
layer's entry and searches the lowest layer with a beam; the best of all shards are
merged. Many queries walk one graph together, so each step is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.text import batch_of, mix
from pairloom.shared import write_table

SHARD_ROWS = 8192  # vectors of a shard, about, as long as there are fewer than SHARDS of them
SHARDS = 16  # beyond, shards grow with the table
MAX_SHARD_ROWS = 32768  # up to this size
LINKS = 16  # of a vector in upper layers; twice as many in the lowest
THINNING = 16  # a layer has this fraction of the one below
BEAM = 200  # candidates kept while the lowest layer is searched
VISITS = 16  # candidates whose links are looked at in one step
WALK = 64  # queries that walk a graph together
QUERY_BLOCK = 2048  # queries that meet a shard together


def usable(vector: str) -> F.Column:
    """Whether a vector can have a cosine: not null or empty, finite components, not all zero.

    A vector whose squares overflow or vanish still counts: lengths are taken in double
    after scaling by the largest component.
    """
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows of ``a`` and ``b``, in double precision, from the original vectors."""
    a = a / np.abs(a).max(-1, keepdims=True)
    b = b / np.abs(b).max(-1, keepdims=True)
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def build(units: np.ndarray, levels: np.ndarray, links: int = LINKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top: (nodes of the layer, flat links with -1 for none).

    Within a layer every node is linked to near nodes that are not nearer to one of its
    links than to itself, the rest filled with the nearest, and links go both ways as
    far as there is room. A shard has a bounded number of vectors, so candidates are
    taken from all of a layer, block by block.
    """
    layers = []
    for level in range(int(levels.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(levels >= level)
        room = links if level else 2 * links
        layers.append((nodes, _linked(units[nodes], room)))
    return layers


def _linked(x: np.ndarray, room: int) -> np.ndarray:
    n = len(x)
    out = np.full((n, room), -1, dtype=np.int32)
    wanted = min(n - 1, 3 * room)
    if wanted < 1:
        return out
    own = room // 2
    picks = np.full((n, own), -1, dtype=np.int64)
    scores = np.full((n, own), -np.inf, dtype=np.float32)
    y = x.astype(np.float32)
    for lo in range(0, n, 512):
        block = np.arange(lo, min(n, lo + 512))
        near = y[block] @ y.T
        near[np.arange(len(block)), block] = -np.inf
        best = np.argpartition(-near, wanted - 1, axis=1)[:, :wanted] if wanted < n - 1 else np.argsort(-near, axis=1)[:, :wanted]
        score = np.take_along_axis(near, best, 1)
        order = np.lexsort([best, -score], axis=1)
        best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
        chosen = np.zeros(best.shape, dtype=bool)
        between = y[best] @ y[best].transpose(0, 2, 1)  # nearness of candidates
        for j in range(wanted):
            covered = (chosen[:, :j] & (between[:, j, :j] > score[:, j, None])).any(1)
            chosen[:, j] = ~covered & (chosen.sum(1) < own)
        # first the diverse ones, then the nearest of the rest
        rank = np.where(chosen, np.arange(wanted), np.arange(wanted) + wanted)
        take = np.argsort(rank, axis=1)[:, : min(own, wanted)]
        picks[block, : take.shape[1]] = np.take_along_axis(best, take, 1)
        scores[block, : take.shape[1]] = np.take_along_axis(score, take, 1)
    # both directions, the nearest first, as far as there is room
    a, b = np.repeat(np.arange(n), own), picks.ravel()
    s = scores.ravel()
    some = b >= 0
    a, b, s = a[some], b[some], s[some]
    kind = np.concatenate([np.zeros(len(a), int), np.ones(len(a), int)])  # own links first
    frm, to, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    order = np.lexsort([to, -s, kind, frm])
    frm, to = frm[order], to[order]
    once = np.unique(frm * np.int64(n) + to, return_index=True)[1]
    keep = np.zeros(len(frm), dtype=bool)
    keep[once] = True
    frm, to = frm[keep], to[keep]
    place = np.arange(len(frm)) - np.searchsorted(frm, frm)
    fits = place < room
    out[frm[fits], place[fits]] = to[fits]
    return out


def search(units: np.ndarray, layers: list, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nodes found for each unit query, nearest first, and their cosines.

    ``WALK`` queries walk together: in every step each query that still has unvisited
    candidates in its beam visits the links of the ``VISITS`` nearest of them. Only nodes that a
    query has not met before are compared with it.
    """
    x, q = units.astype(np.float32), queries.astype(np.float32)
    parts = [_walk(x, layers, q[lo : lo + WALK], beam) for lo in range(0, max(1, len(q)), WALK)]
    return np.concatenate([found for found, _ in parts]), np.concatenate([score for _, score in parts])


def _walk(x: np.ndarray, layers: list, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n_queries = len(q)
    entry = np.zeros(n_queries, dtype=np.int64)
    for depth, (nodes, links) in enumerate(layers):
        own = x[nodes]
        width = min(len(nodes), beam if depth == len(layers) - 1 else 1)
        visits, room = min(VISITS, width), links.shape[1]
        at = np.searchsorted(nodes, entry) if depth else np.zeros(n_queries, dtype=np.int64)
        found = np.full((n_queries, width), -1, dtype=np.int64)
        score = np.full((n_queries, width), -np.inf, dtype=np.float32)
        open_ = np.zeros((n_queries, width), dtype=bool)
        found[:, 0], score[:, 0], open_[:, 0] = at, (own[at] * q).sum(1), True
        met = np.zeros(n_queries * len(nodes), dtype=np.int32)  # 0: not met, else a number of the step it was met in
        met[np.arange(n_queries) * len(nodes) + at] = 1
        active = np.arange(n_queries)
        while len(active):
            left = np.where(open_[active], score[active], -np.inf)
            best = np.argpartition(-left, visits - 1, axis=1)[:, :visits]
            row, col = np.nonzero(np.isfinite(np.take_along_axis(left, best, 1)))
            open_[active[:, None], best] = False
            node = links[found[active[row], best[row, col]]].astype(np.int64).ravel()
            row, place = np.repeat(row, room), (col[:, None] * room + np.arange(room)).ravel()
            key = active[row] * len(nodes) + node
            fresh = np.flatnonzero((node >= 0) & (met[np.where(node >= 0, key, 0)] == 0))
            number = np.arange(1, len(fresh) + 1, dtype=np.int32)
            met[key[fresh]] = number
            fresh = fresh[met[key[fresh]] == number]  # a node linked to several visited ones counts once
            row, place, node = row[fresh], place[fresh], node[fresh]
            near = np.full((len(active), visits * room), -np.inf, dtype=np.float32)
            near[row, place] = np.einsum("bd,bd->b", own[node], q[active[row]])
            ids = np.full(near.shape, -1, dtype=np.int64)
            ids[row, place] = node
            merged = np.concatenate([score[active], near], 1)
            order = np.argpartition(-merged, width - 1, axis=1)[:, :width]
            score[active] = np.take_along_axis(merged, order, 1)
            found[active] = np.take_along_axis(np.concatenate([found[active], ids], 1), order, 1)
            opens = np.concatenate([open_[active], np.isfinite(near)], 1)
            open_[active] = np.take_along_axis(opens, order, 1)
            active = active[open_[active].any(1)]
        order = np.lexsort([found, -score], axis=1)
        found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
        found = np.where(np.isfinite(score), nodes[np.maximum(found, 0)], -1)
        entry = found[:, 0]
    return found, score


def _levels(ids: np.ndarray) -> np.ndarray:
    """Top layer of each vector, from a hash of its id: the same however rows arrive."""
    h = (mix(ids.view(np.uint64) + np.uint64(11)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum(np.floor(-np.log(np.maximum(h, 1e-18)) / np.log(THINNING)), 8).astype(np.int64)


_INDEX = (
    "shard int, n int, dim int, vectors binary, ids array<bigint>, copies array<array<bigint>>, "
    "nodes array<array<int>>, links array<binary>"
)


def _graph(group: pa.Table) -> pa.Table:
    """Flat arrays of one shard."""
    ids = group.column("vec").to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    group, ids = group.take(pa.array(order)), ids[order]
    lists = group.column("vector").combine_chunks()
    dim = group.column("dim")[0].as_py()
    vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
    layers = build(unit(vectors), _levels(ids))
    return pa.table(
        {
            "shard": group.column("shard").slice(0, 1).combine_chunks(),
            "n": pa.array([len(ids)], pa.int32()),
            "dim": pa.array([dim], pa.int32()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "ids": pa.array([ids.tolist()], pa.list_(pa.int64())),
            "copies": pa.array([group.column("copies").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "nodes": pa.array([[n.tolist() for n, _ in layers]], pa.list_(pa.list_(pa.int32()))),
            "links": pa.array([[f.astype(np.int32).tobytes() for _, f in layers]], pa.list_(pa.binary())),
        }
    )


class Index:
    """Stored graphs of all usable vectors: one row for each shard."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", copies: int = 6, shard_rows: int | None = None):
        """Index the rows of ``vectors``.

        Equal vectors are indexed once, with their ``copies`` smallest keys: more can
        never be among the ``copies - 1`` nearest of a query, because ties go to the
        smaller key. They are chosen before the shuffle and again after it, so a vector that
        a third of all rows share moves ``copies`` rows for each task. Vectors of
        different lengths are apart: a query meets only those of its own length. A shard has about
        ``shard_rows`` vectors, else a ``SHARDS``-th of all between ``SHARD_ROWS`` and ``MAX_SHARD_ROWS``: a
        search takes little longer in a larger shard, and every query meets every shard.
        """
        self.copies = copies
        rows = vectors.filter(usable(vector) & F.col(f"`{key}`").isNotNull()).select(
            F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")
        )
        rows = rows.withColumn("hash", F.xxhash64("vector"))
        first = Window.partitionBy("hash", "vector").orderBy("id")
        kept = rows.withColumn("nr", F.dense_rank().over(first)).filter(F.col("nr") <= copies)
        whole = kept.groupBy("hash", "vector").agg(F.sort_array(F.collect_set("id")).alias("copies"))
        self.distinct = write_table(
            whole.select(F.col("copies")[0].alias("vec"), F.size("vector").alias("dim"), "vector", "copies"), "distinct-vectors"
        )
        count = self.distinct.count()
        rows_each = shard_rows or min(MAX_SHARD_ROWS, max(SHARD_ROWS, count // SHARDS))
        self.n_shards = max(1, -(-count // rows_each))
        dealt = self.distinct.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(self.n_shards)).cast("int"))
        dealt = dealt.repartition(self.n_shards, "dim", "shard")  # a shard takes long for its size, so few share a task
        self.shards = write_table(
            dealt.groupBy("dim", "shard").applyInArrow(_graph, _INDEX) if count else vectors.sparkSession.createDataFrame([], _INDEX),
            "graphs",
        )

    def nearest(self, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM) -> DataFrame:
        """query_id, rank, vec_id, score: the ``k`` nearest vectors found for each query row.

        Nearness is the cosine in double precision from the original vectors; ties go to
        the smaller key; a query's own key is no candidate. Queries with an unusable
        vector have no rows, one with fewer candidates has fewer. Repeated query rows
        count once. ``beam`` is raised to ``4 * k`` if smaller. ``k`` must be below the index's
        ``copies``: of more equal vectors the index does not hold enough keys.

        Queries meet the shards in blocks of QUERY_BLOCK, so what one task holds is
        bounded by a shard and a block; each returns ``k`` rows per query, which are
        merged by query.
        """
        if k >= self.copies:
            raise ValueError(f"k={k} needs an index with copies={k + 1} or more, this one has {self.copies}")
        width = max(beam, 4 * k)
        wanted = queries.filter(usable(vector) & F.col(f"`{key}`").isNotNull()).select(
            F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")
        )
        wanted = write_table(wanted.dropDuplicates(["id"]).withColumn("dim", F.size("vector")), "queries")
        n_blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
        blocks = (
            wanted.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
            .groupBy("dim", "block")
            .agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("queries"))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.n_shards - 1))))
        )
        pairs = blocks.join(self.shards, ["dim", "shard"]).repartition(max(1, self.n_shards * n_blocks), "shard", "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    yield from found(one)

        def found(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            get = lambda c: row.column(c)[0]
            n, dim = get("n").as_py(), get("dim").as_py()
            vectors = np.frombuffer(get("vectors").as_py(), np.float64).reshape(n, dim)
            asked = get("queries").values
            ids = asked.field("id").to_numpy()
            wanted = asked.field("vector").flatten().to_numpy().reshape(len(ids), dim)
            layers = [
                (np.array(nodes, dtype=np.int64), np.frombuffer(links, np.int32).reshape(len(nodes), -1))
                for nodes, links in zip(get("nodes").as_py(), get("links").as_py())
            ]
            copies = get("copies").as_py()
            nodes, _ = search(unit(vectors), layers, unit(wanted), width)
            query, at = np.nonzero(nodes >= 0)
            node = nodes[query, at]
            score = cosine(wanted[query], vectors[node])
            counts = np.array([len(copies[x]) for x in range(n)])
            out_q = np.repeat(query, counts[node])
            out_s = np.repeat(score, counts[node])
            out_v = np.array([v for x in node for v in copies[x]], dtype=np.int64)
            other = out_v != ids[out_q]
            out_q, out_s, out_v = out_q[other], out_s[other], out_v[other]
            order = np.lexsort([out_v, -out_s, out_q])
            out_q, out_s, out_v = out_q[order], out_s[order], out_v[order]
            few = np.arange(len(out_q)) - np.searchsorted(out_q, out_q) < k
            yield batch_of({"query_id": ids[out_q[few]], "vec_id": out_v[few], "score": out_s[few]})

        each = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return (
            each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        )
