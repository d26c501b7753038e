"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has many virtual nodes on a ring of 2**60 places; a row's place is the hash
of its group (equal texts), so equal texts lie side by side. A row belongs to the first
virtual node clockwise whose shard is not full; keys that overflow a full shard continue
clockwise. Rows are taken in ring order, so the whole assignment is one walk of two laps
over the virtual nodes: each takes as many of the waiting rows, from the front, as its
shard has room for. The walk needs nothing but the number of rows before each virtual
node, and gives at most two segments of consecutive rows for each of them.

Spark expressions only. The rows are counted by arc, sorted once by their place over all
tasks, and looked up in the segments. Ring, counts and segments have a number of rows set
by shards and virtual nodes, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators.keys import row_index
from pairloom.shared import write_table

RING_DIGITS = 15  # hex digits of an md5: 60 bits
NODES = 64  # virtual nodes of a shard
CELLS = 4096  # equal pieces of the ring, and of the row numbers, by which ranges are joined


def place(value: Column) -> Column:
    """The place of a text on the ring, 0 to 2**60 - 1."""
    return F.conv(F.substring(F.md5(value), 1, RING_DIGITS), 16, 10).cast("bigint")


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> DataFrame:
    """``visit, shard, at``: all virtual nodes in clockwise order."""
    node = spark.range(shards * nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        place(F.concat_ws("/", F.lit("shard"), F.col("id") % shards, F.expr(f"id div {shards}"))).alias("at"),
    )
    order = Window.orderBy("at", "shard")  # shards * nodes rows
    return node.select((F.row_number().over(order) - 1).alias("visit"), "shard", "at")


def _cells(ranges: DataFrame, first: Column, last: Column) -> DataFrame:
    """Each range once for every cell that it meets."""
    return ranges.withColumn("_cell", F.explode(F.sequence(first, last)))


def _before_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``visit, shard, upto``: how many rows lie at or before each virtual node."""
    width = (1 << (4 * RING_DIGITS)) // CELLS
    order = Window.orderBy("visit")
    arcs = nodes.select("visit", F.coalesce(F.lag("at").over(order), F.lit(-1)).alias("_lo"), F.col("at").alias("_hi"))
    arcs = arcs.filter(F.col("_lo") < F.col("_hi"))  # of nodes at one place the first has the arc
    arcs = _cells(arcs, F.expr(f"(_lo + 1) div {width}"), F.expr(f"_hi div {width}"))
    found = rows.select("_place", F.expr(f"_place div {width}").alias("_cell")).join(F.broadcast(arcs), "_cell")
    counts = found.filter(F.col("_place").between(F.col("_lo") + 1, F.col("_hi"))).groupBy("visit").count()
    upto = F.coalesce(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return nodes.join(F.broadcast(counts), "visit", "left").select("visit", "shard", upto.alias("upto"))


def _segments(before: DataFrame, n: int, shards: int, load: float | None) -> DataFrame:
    """``_from, _to, shard, _base``: the rows that a visit takes, and its shard's rows before them."""
    if load is None:
        room = [n // shards + (s < n % shards) for s in range(shards)]
    else:
        room = [-int(-load * n // shards)] * shards
    capacity = F.array(*[F.lit(r).cast("bigint") for r in room])
    lap = lambda i, upto: F.struct((F.col("visit") + F.lit(i) * before_all).alias("visit"), "shard", upto.alias("upto"))
    before_all = F.lit(1 << 40)
    laps = F.array(lap(0, F.col("upto")), lap(1, F.lit(n).cast("bigint")))
    visits = before.select(F.explode(laps).alias("v")).agg(F.sort_array(F.collect_list("v")).alias("visits"))
    nothing = F.array().cast("array<struct<_from:bigint,shard:int,_base:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), capacity.alias("room"), nothing.alias("out"))

    def step(state: Column, v: Column) -> Column:
        left = F.get(state["room"], v["shard"])
        take = F.greatest(F.lit(0).cast("bigint"), F.least(v["upto"] - state["at"], left))
        new = F.struct(state["at"].alias("_from"), v["shard"].alias("shard"), (F.get(capacity, v["shard"]) - left).alias("_base"))
        return F.struct(
            (state["at"] + take).alias("at"),
            F.transform(state["room"], lambda x, i: F.when(i == v["shard"], x - take).otherwise(x)).alias("room"),
            F.when(take > 0, F.concat(state["out"], F.array(new))).otherwise(state["out"]).alias("out"),
        )

    out = visits.select(F.explode(F.aggregate("visits", start, step)["out"]).alias("s")).select("s.*")
    to = F.coalesce(F.lead("_from").over(Window.orderBy("_from")), F.lit(n)).cast("bigint")
    return out.withColumn("_to", to)


def assign_shards(
    docs: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    group: str | None = None,
    nodes: int = NODES,
    load: float | None = None,
) -> DataFrame:
    """``key``, size, text_crc32, shard, slot: a shard from 0 and a place in it for every row.

    A shard's room is ``ceil(load * rows / shards)`` rows; a load near 1 balances more, a
    higher one moves fewer rows when a shard is added. Without ``load`` the rooms add up to
    the number of rows, so that counts differ by one at most. ``group`` (the text by
    default) gives a row its place on the ring: rows of one group go to one shard as far as
    its room allows and then to the next ones clockwise. Rows of one place are taken in the
    order of ``key``, null first. Slots count a shard's rows from 0 without gaps.

    ``size`` is the text's UTF-8 bytes plus 8, ``text_crc32`` its unsigned CRC. A null
    text, or group, counts as empty. Rows that repeat wholly are interchangeable; each has a slot of its
    own. No rows give no rows. Other columns are not read, so their names do not matter.
    """
    if shards < 1 or nodes < 1 or (load is not None and load < 1):
        raise ValueError("shards and nodes are 1 or more, and load is too")
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = write_table(
        docs.select(
            F.col(f"`{key}`").alias("_key"),
            (F.octet_length(value) + 8).cast("bigint").alias("size"),
            F.crc32(value).alias("text_crc32"),
            place(F.coalesce(F.col(f"`{group or text}`").cast("string"), F.lit(""))).alias("_place"),
            F.monotonically_increasing_id().alias("_tie"),
        ),
        "shard-rows",
    )
    n = rows.count()
    nodes_ = write_table(ring(docs.sparkSession, shards, nodes), "shard-ring")
    segments = write_table(_segments(_before_nodes(rows, nodes_), n, shards, load), "shard-segments")
    cell = lambda c: F.floor(c * CELLS / max(n, 1)).cast("bigint")
    ranges = _cells(segments, cell(F.col("_from")), cell(F.col("_to") - 1))
    numbered = row_index(rows, "_place", "_key", "_tie", name="_at").withColumn("_cell", cell(F.col("_at")))
    found = numbered.join(F.broadcast(ranges), "_cell").filter((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    slot = (F.col("_base") + F.col("_at") - F.col("_from")).alias("slot")
    return found.select(F.col("_key").alias(key), "size", "text_crc32", "shard", slot)
