"""Removal of the repeated pairs that augmentation makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.keys import text_key
from pairloom.schemas import require_columns
from pairloom.shared import write_table


COPIES = 64  # rows of one source that move together
BROADCAST_PAIRS = 500_000  # 16-byte keys: 8 MB
FEW_ROWS = 100_000  # foreign rows that are joined as they are
CHUNK = 15  # bits of a key within its bitmap, as bitmap_construct_agg has them: 32,768 keys in 4 KB
MAX_BITMAPS = 16_384  # 64 MB


def _pair() -> Column:
    return text_key(F.col("sentence"), F.col("paraphrase")).alias("_pair")


def _foreign() -> Column:
    return ~F.col("lang").eqNullSafe("en")


def _refuse_repeated(df: DataFrame, order: str) -> None:
    repeated = df.groupBy(order).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(order).isNull())
    if repeated.limit(1).count():
        raise ValueError(f"{order} is not a unique row key; number the rows first (row_index)")


def _few_copies(df: DataFrame, order: str) -> bool:
    """Whether ``index`` names a source with few foreign rows for every one of them."""
    if "index" not in df.columns or order == "index":
        return False
    counts = df.groupBy("index").agg(F.count(F.lit(1)).alias("n"))
    most, lost = counts.agg(F.max("n"), F.max(F.col("index").isNull().cast("int"))).first()
    return most is not None and most <= COPIES and not lost


def _way(foreign: DataFrame, order: str) -> str:
    """How the foreign rows that stay are found: by ``bitmaps`` of their keys, by ``source`` or by ``key``."""
    n, low, high = foreign.agg(F.count(F.lit(1)), F.min(order), F.max(order)).first()
    if n <= FEW_ROWS:
        return "key"
    if isinstance(foreign.schema[order].dataType, T.IntegralType) and (high >> CHUNK) - (low >> CHUNK) < MAX_BITMAPS:
        return "bitmaps"
    return "source" if _few_copies(foreign, order) else "key"


def _by_bitmaps(foreign: DataFrame, kept: DataFrame, order: str) -> DataFrame | None:
    """``_found`` by a broadcast of bitmaps of the kept keys, so that no text moves; None where they are too many.

    A bitmap holds the keys of one run of 32,768 with the same other columns of ``kept``.
    """
    more = [c for c in kept.columns if c != order]
    key = F.col(order).cast("bigint")
    chunk = F.shiftright(key, CHUNK).alias("_chunk")
    bits = kept.select(chunk, *more, key.bitwiseAND((1 << CHUNK) - 1).alias("_bit")).repartition("_chunk")
    bits = write_table(bits.groupBy("_chunk", *more).agg(F.bitmap_construct_agg("_bit").alias("_bits")), "kept-keys")
    if bits.count() > MAX_BITMAPS:
        return None
    place = key.bitwiseAND((1 << CHUNK) - 1)
    byte = F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), place.bitwiseAND(7).cast("int")) == 1
    own = foreign.withColumn("_chunk", chunk).join(F.broadcast(bits), "_chunk").filter(held)
    return own.select(*foreign.columns, *more)


def _found(foreign: DataFrame, kept: DataFrame, order: str, way: str) -> DataFrame:
    """The foreign rows whose key is in ``kept``, with the other columns of ``kept``.

    By ``source`` the rows of one source move together: they differ little, so
    that they are compressed to a fraction, and the kept keys of a source, ``COPIES`` at most,
    are looked up in one list. The wide side is not sorted.
    """
    if way == "bitmaps":
        marked = _by_bitmaps(foreign, kept, order)
        if marked is not None:
            return marked
    if way != "source":
        return foreign.join(kept, order)
    more = [c for c in kept.columns if c not in (order, "index")]
    lists = kept.groupBy("index").agg(F.collect_list(F.struct(order, *more)).alias("_kept"))
    joined = foreign.join(lists.hint("shuffle_hash"), "index")
    own = F.filter("_kept", lambda e: e[order] == F.col(order))
    marked = joined.withColumn("_own", F.get(own, F.lit(0))).filter(F.col("_own").isNotNull())
    return marked.select(*foreign.columns, *[F.col("_own")[c].alias(c) for c in more])


def remove_duplicates(
    df: DataFrame, order: str = "IDS", by: str | None = None, check: bool = True
) -> DataFrame:
    """Drop every non-English row whose pair occurs earlier, in ``order``.

    Null texts are equal to each other and a null language is not English. English
    rows all stay. A foreign row stays exactly when it is the first of its pair.
    One hash aggregate by the pair's 16-byte key, with map-side combine, finds the first key of
    each pair and the first foreign one; where they are equal, that foreign row is
    kept: by a broadcast of bitmaps where keys are dense whole numbers (``row_index``), else by a join on the key, or on
    ``index`` where a source has few copies. English rows
    enter the aggregate alone, and no text does. A pair that fills a third of
    the table shrinks to one row per map task.

    ``order`` must be a unique row key without nulls; ``check`` counts the keys and raises
    ``ValueError`` if it is not, because the result would then depend on the
    partitioning. ``df`` is read once for each branch, so it should be stored.

    With ``by`` the rule is the literal one for keys that several rows share:
    one repeated foreign row removes all rows with its ``by`` value.
    """
    require_columns(df, "sentence", "paraphrase", "lang", order)
    if check:
        _refuse_repeated(df, order)
    pairs = df.groupBy(_pair())
    first = F.min(order).alias("_first")
    foreign = df.filter(_foreign())
    if by is None:
        way = _way(foreign, order)
        by_source = way == "source"
        own = F.when(_foreign(), F.col(order))
        source = [F.min_by("index", own).alias("index")] if by_source else []
        firsts = pairs.agg(first, F.min(own).alias("_foreign"), *source).filter(F.col("_first") == F.col("_foreign"))
        kept = firsts.select(F.col("_first").alias(order), *(["index"] if by_source else []))
        return df.filter(~_foreign()).unionByName(_found(foreign, kept, order, way).select(df.columns))
    later = foreign.select(order, by).join(pairs.agg(first.alias(order)), order, "left_anti")
    return df.join(later.select(by).distinct(), by, "left_anti")


def remove_duplicates_in_sets(
    df: DataFrame, sets: dict[str, list[str]], order: str = "IDS", check: bool = True, part: DataFrame | None = None
) -> DataFrame:
    """``remove_duplicates`` within every language set at once: adds ``lang_sets``.

    A row's ``lang_sets`` names the sets in which it stays: for an English row all sets
    with English, for a foreign row those of its language in which no row of the set has
    the same pair earlier in ``order``. Rows that stay in no set are left out. The first
    rows of all sets come from one hash aggregate by the pair's key, a minimum for each language, so
    no text is grouped whatever the number of sets, and rows are never copied.

    With ``part``, some rows of ``df`` that are stored, the result is that of ``df`` for these rows alone:
    of the other rows only those with the pair of a foreign one among them are grouped. Up to
    ``BROADCAST_PAIRS`` such pairs are broadcast, so that no other row is moved.
    """
    require_columns(df, "sentence", "paraphrase", "lang", order)
    if check:
        _refuse_repeated(df, order)
    rows = df if part is None else part
    foreign = rows.filter(_foreign())
    way = _way(foreign, order) if part is None else "key"
    by_source = way == "source"
    codes = sorted({c for own in sets.values() for c in own})
    place = {c: i for i, c in enumerate(codes)}
    firsts = []
    for c, i in place.items():
        own = F.when(F.col("lang") == c, F.col(order))
        firsts.append(F.min(own).alias(f"_{i}"))
        if by_source and c != "en":
            firsts.append(F.min_by("index", own).alias(f"_from_{i}"))
    none = F.lit(None).cast(df.schema[order].dataType)

    def first(own: list[str]) -> Column:
        return F.least(none, none, *[F.col(f"_{place[c]}") for c in own])

    entries = [
        F.struct(F.lit(name).alias("name"), F.when(first(own) == first([c for c in own if c != "en"]), first(own)).alias("key"))
        for name, own in sets.items()
    ]
    paired = df.withColumn("_pair", _pair())
    if part is not None:
        pairs = foreign.select(_pair()).distinct()
        few = foreign.count() <= BROADCAST_PAIRS
        paired = paired.join(F.broadcast(pairs) if few else pairs, "_pair", "left_semi")
    by_pair = paired.groupBy("_pair").agg(*firsts)
    kept = by_pair.withColumn("_kept", F.filter(F.array(*entries), lambda e: e["key"].isNotNull()))
    keys = F.array_distinct(F.transform("_kept", lambda e: e["key"]))
    each = kept.withColumn(order, F.explode(keys))
    names = F.transform(F.filter("_kept", lambda e: e["key"] == F.col(order)), lambda e: e["name"])
    sources = [F.when(F.col(f"_{i}") == F.col(order), F.col(f"_from_{i}")) for c, i in place.items() if c != "en"]
    source = [F.coalesce(*sources).alias("index")] if by_source and sources else []
    kept = each.select(order, names.alias("lang_sets"), *source)
    english = F.array(*[F.lit(name) for name, own in sets.items() if "en" in own]).cast("array<string>")
    whole = rows.filter(~_foreign()).withColumn("lang_sets", english).filter(F.size("lang_sets") > 0)
    return whole.unionByName(_found(foreign, kept, order, "key" if by_source and not source else way))
