"""Row keys: a dense row index, and exact cuts of a random order.

Spark rows have no order, so every operator that depends on one takes a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.labels import rank_key
from pairloom.shared import CODEC, fresh_path, write_table

HEX_DIGITS = 3  # 4096 buckets for each pass of a cut
MAX_BLOCKS = 2_000_000  # input splits whose starts (16 bytes each) may be broadcast
SMALL_BUCKET = 20_000  # a bucket this small may be looked at value by value


def text_key(*texts: Column) -> Column:
    """16 bytes in place of texts as a key to group and join by: their md5, with lengths, nulls told apart."""
    sized = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.md5(F.concat(*sized)))


def row_index(df: DataFrame, *order: str | Column, name: str = "IDS") -> DataFrame:
    """Number the rows 0..n-1 in the given order.

    The order is one range-partitioned sort, written once. Parquet knows the
    position of a row in its file, so the numbers follow from a running sum of
    the rows per file: no window over the rows and no second sort. The sums have
    one row per written file, as many as the sort has partitions whatever the
    data, and counting them reads no column.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "sorted")
    body = df.orderBy(*order).drop(name)
    body.write.option("compression", CODEC).parquet(path)
    stored = spark.read.schema(body.schema).parquet(path).select(
        "*",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    part = F.regexp_extract("_file", r"part-(\d+)-", 1).cast("bigint")
    piece = F.regexp_extract("_file", r"-c(\d+)", 1).cast("bigint")
    files = stored.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(part, piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return stored.join(F.broadcast(starts), "_file").select(
        (F.col("_first") + F.col("_row")).alias(name), *body.columns
    )


def file_row_index(scan: DataFrame, name: str = "IDS", header: bool = False) -> DataFrame:
    """Number the rows of a text or CSV scan in file order, then line order.

    The files are scanned once: rows are stored with a hash of their file block and
    their running id, and everything else is read from the stored table, so it does
    not matter if Spark would cut the files differently later. The table of blocks has
    one row of 16 bytes for each input split; it is broadcast up to MAX_BLOCKS rows and
    joined by the strategy Spark picks beyond, on the 8-byte hash. A row without a block,
    or two blocks with one hash, fail the job. With ``header`` the first line of every
    file is dropped and not counted.
    """
    start = F.col("_metadata.file_block_start")
    stored = write_table(
        scan.select(
            "*",
            F.col("_metadata.file_path").alias("_path"),
            start.alias("_start"),
            F.xxhash64("_metadata.file_path", start).alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "scan",
    )
    head = F.when(F.col("_start") == 0, 1).otherwise(0) if header else F.lit(0)
    blocks = stored.groupBy("_path", "_start", "_block").agg(
        F.min("_at").alias("_lo"), (F.count(F.lit(1)) - head).alias("_n")
    )
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = write_table(
        blocks.select(
            "_block",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo") - head).alias("_shift"),
            (F.col("_lo") + head).alias("_from"),
        ),
        "block-starts",
    )
    n_blocks, n_hashes = starts.agg(F.count(F.lit(1)), F.count_distinct("_block")).first()
    if n_blocks != n_hashes:
        raise RuntimeError("two file blocks have one hash; rename a file")
    placed = stored.join(F.broadcast(starts) if n_blocks <= MAX_BLOCKS else starts, "_block", "left")
    lost = F.raise_error(F.lit("a row has no file block")).cast("bigint")
    return placed.filter(F.coalesce(F.col("_at") >= F.col("_from"), lost.isNotNull())).select(
        (F.col("_at") + F.col("_shift")).alias(name), *scan.columns
    )


def hash_cuts(
    df: DataFrame,
    key: str,
    seed: int,
    places: Callable[[int], list[int]],
    group: str | None = None,
) -> dict:
    """For each group, the rank keys that end the first ``k`` rows in hash order.

    ``places`` maps the size of a group to the wanted ``k``, in rising order; it
    may raise. Rows with ``rank_key <= cut`` are then exactly ``k`` rows, so the
    caller filters and never sorts. Each pass counts rows by the next hex digits
    of the rank key (4096 counts for each group), and goes into the bucket that
    holds the cut until that bucket is small; only that bucket's keys come to
    the driver, at most ``SMALL_BUCKET`` of them for each cut. ``group`` must
    have few values (the labels). The keys must be unique.
    """
    part = F.col(group) if group else F.lit(0)
    ranked = df.select(part.alias("g"), rank_key(F.col(key), seed).alias("r"))

    def histogram(rows: DataFrame, length: int) -> dict:
        counted = rows.groupBy("g", F.substring("r", 1, length).alias("p")).count()
        found: dict = {}
        for g, p, n in counted.collect():
            found.setdefault(g, {})[p] = n
        return found

    first = histogram(ranked, HEX_DIGITS)
    cuts: dict = {}
    open_cuts = []  # group, position of the cut, prefix, rows wanted from it, rows in it
    for g, counts in first.items():
        total = sum(counts.values())
        wanted = places(total)
        cuts[g] = [None] * len(wanted)
        for i, k in enumerate(wanted):
            if k <= 0:
                cuts[g][i] = ""
            elif k >= total:
                cuts[g][i] = "~"
            else:
                open_cuts.append((g, i, *_descend(counts, k)))

    length = HEX_DIGITS
    while any(n > SMALL_BUCKET for *_, n in open_cuts):
        if length >= 32:
            raise ValueError(f"{key} is not a unique row key")
        length += HEX_DIGITS
        deep = [c for c in open_cuts if c[4] > SMALL_BUCKET]
        counts = histogram(ranked.filter(_in_buckets(deep)), length)
        open_cuts = [c for c in open_cuts if c[4] <= SMALL_BUCKET] + [
            (g, i, *_descend({p: n for p, n in counts[g].items() if p.startswith(pre)}, k))
            for g, i, pre, k, _ in deep
        ]

    if open_cuts:
        rows = ranked.filter(_in_buckets(open_cuts)).collect()
        for g, i, prefix, k, _ in open_cuts:
            keys = sorted(r for h, r in rows if h == g and r.startswith(prefix))
            if keys[k - 1 : k + 1].count(keys[k - 1]) > 1:
                raise ValueError(f"{key} is not a unique row key")
            cuts[g][i] = keys[k - 1]
    return cuts


def _descend(counts: dict, k: int) -> tuple[str, int, int]:
    """The bucket that holds row ``k``, the rows wanted from it, and its size."""
    for prefix in sorted(counts):
        if k <= counts[prefix]:
            return prefix, k, counts[prefix]
        k -= counts[prefix]
    raise AssertionError("the cut lies past the last bucket")


def _in_buckets(open_cuts: list) -> Column:
    cond = F.lit(False)
    for g, _, prefix, _, _ in open_cuts:
        cond = cond | (F.col("g").eqNullSafe(F.lit(g)) & F.col("r").startswith(prefix))
    return cond
