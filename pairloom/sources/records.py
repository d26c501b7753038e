"""Quoted files whose fields may hold line ends, scanned in many tasks.

Spark reads such a file in one task, because a line end may lie inside quotes. Here lines
are scanned like any text, and only the record boundaries are found: each line is a
function from the state before it (inside quotes or not) to the state after it, which is
the same, the other, or a fixed one. Such functions compose to such functions, so each
file block is summed up on its own, a window over the blocks (one row each) gives the
state in which a block begins, and a window inside each block gives that of every line.
Lines that begin inside quotes join the record before them. Spark's own parser then reads
each record.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.shared import write_table

BOM = "﻿"


def _ends_inside(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line leaves quotes open: if it begins outside them, and if inside.

    A quote opens a field only at its beginning. After the closing one, and in a field that
    begins otherwise, quotes are plain characters up to the next separator.
    """
    s = re.escape(sep)
    quoted = '[^"]*+(?:""[^"]*+)*+'
    field = f'(?:"{quoted}"[^{s}]*+|(?!")[^{s}]*+)'
    # Doubled quotes amid other characters change no state; without them the patterns stay shallow.
    plain = F.regexp_replace(line, f'(?<=[^"{s}])""(?!")', "")
    none = ~F.contains(line, F.lit('"'))
    from_outside = ~none & F.regexp_like(plain, F.lit(f'^(?:{field}{s})*+"{quoted}$'))
    from_inside = none | F.regexp_like(plain, F.lit(f'^{quoted}(?:"[^{s}]*+(?:{s}{field})*+{s}"{quoted})?$'))
    return from_outside, from_inside


def _after(first: Column, last: Column, swaps: Column) -> Column:
    """The state after functions: the last fixed one's (or the first state), swapped so often."""
    since = swaps - F.coalesce(last["swaps"], F.lit(0))
    return F.coalesce(last["state"], first) != (since % 2 == 1)


def _fixed(order: Column | str = "_swaps") -> Column:
    return F.when(F.col("_fixed").isNotNull(), F.struct(F.col("_fixed").alias("state"), F.col(order).alias("swaps")))


def quoted_records(spark: SparkSession, path: str, sep: str, header: bool = False) -> tuple[DataFrame, DataFrame]:
    """``IDS, record`` of all files, numbered in the order of paths and lines, and the header records.

    A record is the text of one row without its line end; line ends inside quotes become
    single line feeds. Blank lines between records are left out. With ``header`` the first record of every
    file is not counted; these records are the second table (else empty), for which only
    their own lines are moved. A task sorts the lines of one file block; a record of several lines is put together in one task.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    start = F.col("_metadata.file_block_start")
    at = F.monotonically_increasing_id()
    from_outside, from_inside = _ends_inside(F.col("value"), sep)
    stored = write_table(
        scan.select("value", F.col("_metadata.file_path").alias("_path"), start.alias("_start"), at.alias("_at"))
        .withColumn("value", F.when(F.col("_start") == 0, F.regexp_replace("value", f"^{BOM}", "")).otherwise(F.col("value")))
        .withColumns({"_out": from_outside, "_in": from_inside})
        .select(
            "value",
            "_path",
            "_start",
            "_at",
            F.col("value").endswith("\r").alias("_cr"),
            (F.length("value") - F.col("value").endswith("\r").cast("int") == 0).alias("_blank"),
            F.when(F.col("_out") & ~F.col("_in"), 1).otherwise(0).alias("_swap"),
            F.when(F.col("_out") == F.col("_in"), F.col("_out")).alias("_fixed"),
        ),
        "lines",
    )
    # Like Spark's reader: a file whose first line ends in \r\n has these line ends, else \r is text.
    ends = stored.filter("_start = 0").groupBy("_path").agg(F.min_by("_cr", "_at").alias("_crlf"))
    stored = stored.join(write_table(ends, "line-ends"), "_path").withColumn("_blank", F.col("_blank") & (F.col("_crlf") | ~F.col("_cr")))
    inside = Window.partitionBy("_path", "_start").orderBy("_at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)

    def with_states(lines: DataFrame) -> DataFrame:
        lines = lines.withColumn("_swaps", F.coalesce(F.sum("_swap").over(earlier), F.lit(0)))
        return lines.withColumn("_last", F.last(_fixed(), ignorenulls=True).over(earlier))

    states = {f"_s{i}": _after(F.lit(bool(i)), F.col("_last"), F.col("_swaps")) for i in (0, 1)}
    begun = lambda i: F.when(~F.col(f"_s{i}") & ~F.col("_blank"), 1)
    so_far = {f"_c{i}": F.count(begun(i)).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for i in (0, 1)}
    begin = lambda i: F.count(begun(i)).alias(f"_n{i}")
    second = lambda i: F.min(F.when(F.col(f"_c{i}") == 2, F.col("_at"))).alias(f"_stop{i}")
    summed = with_states(stored).withColumns(states).withColumns(so_far).groupBy("_path", "_start").agg(
        F.max_by(_fixed(), F.when(F.col("_fixed").isNotNull(), F.col("_at"))).alias("_end"),
        F.sum("_swap").alias("_all"),
        *[count(i) for count in (begin, second) for i in (0, 1)],
    )
    # The same for blocks: one row for each input split.
    summed = write_table(summed, "block-states")
    by_file = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    whole = summed.withColumns(
        {
            "_fixed": F.when(F.col("_end").isNotNull(), _after(F.lit(False), F.col("_end"), F.col("_all"))),
            "_swap": F.when(F.col("_end").isNull(), F.col("_all") % 2).otherwise(0),
        }
    )
    whole = whole.withColumn("_swaps", F.coalesce(F.sum("_swap").over(by_file), F.lit(0)))
    whole = whole.withColumn("_last", F.last(_fixed(), ignorenulls=True).over(by_file))
    whole = whole.withColumn("_open", _after(F.lit(False), F.col("_last"), F.col("_swaps")))
    whole = whole.withColumn("_n", F.when(F.col("_open"), F.col("_n1")).otherwise(F.col("_n0")))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    file_ = Window.partitionBy("_path")
    numbered = whole.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = numbered.withColumns({"_of_file": F.min("_first").over(file_), "_in_file": F.sum("_n").over(file_)})
    files = Window.orderBy("_path")
    headers = F.dense_rank().over(files) if header else F.lit(0)
    stop = F.when(F.col("_open"), F.col("_stop1")).otherwise(F.col("_stop0")).alias("_stop")
    blocks = write_table(
        numbered.filter(F.col("_in_file") > 0).select("_path", "_start", "_open", "_first", "_of_file", headers.alias("_headers"), stop),
        "block-starts",
    )
    numbered = blocks.drop("_stop")

    def records_of(lines: DataFrame) -> DataFrame:
        # Beyond Spark's broadcast threshold the blocks are joined by a shuffle.
        text = F.when(F.col("_crlf"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
        placed = with_states(lines).join(numbered, ["_path", "_start"]).withColumn("value", text)
        placed = placed.withColumn("_inside", _after(F.col("_open"), F.col("_last"), F.col("_swaps")))
        placed = placed.filter(F.col("_inside") | ~F.col("_blank"))
        started = F.sum(F.when(F.col("_inside"), 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        placed = placed.withColumn("_record", F.col("_first") + started - 1)
        closed = ~F.when(F.col("_fixed").isNotNull(), F.col("_fixed")).otherwise(F.col("_inside") != (F.col("_swap") == 1))
        one = ~F.col("_inside") & closed
        names = ["_record", "_of_file", "_headers"]
        several = (
            placed.filter(~one)
            .groupBy(*names)
            .agg(F.sort_array(F.collect_list(F.struct("_at", "value"))).alias("_lines"))
            .select(*names, F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("record"))
        )
        return placed.filter(one).select(*names, F.col("value").alias("record")).unionByName(several)

    first = F.col("_record") == F.col("_of_file") if header else F.lit(False)
    rows = records_of(stored).filter(~first).select((F.col("_record") - F.col("_headers")).cast("bigint").alias("IDS"), "record")
    # In a block a file's first record ends before the second one that begins there.
    own = blocks.filter(F.col("_first") <= F.col("_of_file") + 1).select("_path", "_start", "_stop")
    before_second = F.col("_stop").isNull() | (F.col("_at") < F.col("_stop"))
    heads = records_of(stored.join(own, ["_path", "_start"]).filter(before_second).drop("_stop"))
    return rows, heads.filter(first).select("record")
