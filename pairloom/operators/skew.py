"""Equi joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.shared import write_table

PIECES = 100_000  # a key with more than 1/PIECES of the rows is split
MIN_PIECE = 10_000  # rows that never need splitting


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str],
    row_key: str,
    how: str = "inner",
    pieces: int = PIECES,
    min_piece: int = MIN_PIECE,
) -> DataFrame:
    """Join ``big`` with ``small`` on key columns, splitting the hot keys of ``big``.

    ``small`` has at most one row per key. Keys are counted by their hash with
    map-side combine; a hash with more than ``piece`` rows gets one salt for
    each ``piece`` rows, its ``big`` rows are dealt to the salts by ``row_key``
    and its ``small`` row is repeated once per salt. No task then gets more than
    about ``piece`` rows of one key. The table of hot hashes has fewer than
    ``pieces`` rows of 12 bytes by construction, whatever the data, so both
    sides may look it up by broadcast. A null key matches nothing; ``how`` is
    ``inner``, ``left``, ``left_semi`` or ``left_anti``.

    ``big`` is read twice, once to count its keys and once to join: store it first when
    it is costly to compute.
    """
    on = [on] if isinstance(on, str) else on
    counts = big.groupBy(F.xxhash64(*on).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each frequent hash, and one without hash for all the others together.
    often = F.when(F.col("_n") > min_piece, F.col("_h"))
    frequent = write_table(counts.groupBy(often.alias("_h")).agg(F.sum("_n").alias("_n")), "hot-keys")
    total, largest = frequent.agg(F.sum("_n"), F.max(F.when(F.col("_h").isNotNull(), F.col("_n")))).first()
    largest = largest or 0
    piece = max(min_piece, -(-total // pieces)) if largest else min_piece
    if largest <= piece:
        return big.join(small, on, how)

    hot = F.broadcast(
        frequent.filter(F.col("_h").isNotNull() & (F.col("_n") > piece)).select(
            "_h", F.ceil(F.col("_n") / piece).cast("int").alias("_salts")
        )
    )
    salts = F.coalesce("_salts", F.lit(1))
    dealt = big.withColumn("_h", F.xxhash64(*on)).join(hot, "_h", "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(row_key), salts).cast("int"))
    copies = small.withColumn("_h", F.xxhash64(*on)).join(hot, "_h", "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.drop("_h", "_salts").join(copies.drop("_h", "_salts"), [*on, "_salt"], how).drop("_salt")
