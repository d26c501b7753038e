"""URL filters from dated lists: validity intervals and an as-of join, DataFrame functions only.

A list changes over time. Its dated entries become intervals in which a key (a host, for
itself and all hosts below it, or a whole URL) is on the list, and each capture is judged
by the intervals that hold at its fetch time. Captures never meet the entries of their
host one by one: the entries of a host are folded into one sorted array, and a capture
looks that array up, so a host with a third of all captures adds no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.skew import salted_join
from pairloom.shared import write_table

_INTERVALS = "array<struct<list:string,key:string,valid_from:timestamp,valid_to:timestamp>>"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and closing dots; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def url_key(url: Column) -> Column:
    """A URL without scheme, user, port, query, fragment and closing slashes; the host in lower case."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path, "/+$", ""))


def parents(host: Column) -> Column:
    """A host and all hosts above it: a.b.c, b.c, c. An address in numbers has none above it."""
    numbers = F.rlike(host, F.lit(r"^[0-9]+(\.[0-9]+){3}$|^\["))
    labels = F.when(numbers, F.array(host)).otherwise(F.split(host, r"\."))
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``valid_from <= t < valid_to`` in which a key is on a list.

    ``entries`` has list, kind (``host`` or ``url``), key, action (``add`` or
    ``remove``) and effective_at. An ``add`` opens an interval unless one is open, and
    the next ``remove`` closes it; an open end is null. Of entries at one instant the
    removal counts last. Repeated entries change nothing. Entries with a null or unknown
    column value have no effect.
    """
    known = entries.select("list", "kind", "key", "action", "effective_at").filter(
        F.col("list").isNotNull()
        & F.col("kind").isin("host", "url")
        & F.col("key").isNotNull()
        & F.col("action").isin("add", "remove")
        & F.col("effective_at").isNotNull()
    )
    # One row for each instant, then only rows at which the state changes.
    states = known.groupBy("list", "kind", "key", "effective_at").agg(
        (F.max("action") == "add").alias("listed")
    )
    by_key = Window.partitionBy("list", "kind", "key").orderBy("effective_at")
    changes = states.withColumn("before", F.lag("listed", 1, False).over(by_key)).filter(
        F.col("listed") != F.col("before")
    )
    return (
        changes.withColumn("valid_to", F.lead("effective_at").over(by_key))
        .filter("listed")
        .select("list", "kind", "key", F.col("effective_at").alias("valid_from"), "valid_to")
    )


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``url_host``, ``url_lists`` and ``url_listed`` as of each fetch time.

    ``url_lists`` has the names of all lists, sorted, that name the capture's host, a host
    above it or its URL at the fetch time; ``url_listed`` is true when there are any.
    A null or malformed URL and a null fetch time are on no list. Repeated captures each
    get their row. Columns of ``captures`` with a result's name give way to it; other
    columns pass. Without entries nothing is listed; without captures no row returns.

    Only distinct hosts and URLs are expanded to their parents and joined with the
    intervals. The joins back to the captures split hot hosts and URLs over many tasks.
    """
    found = ["url_host", "url_lists", "url_listed"]
    rest = [F.col(f"`{c}`") for c in captures.columns if c.lower() not in found]
    rows = write_table(
        captures.select(
            F.struct(*rest).alias("row"),
            host_of(F.col(f"`{url}`")).alias("host"),
            url_key(F.col(f"`{url}`")).alias("page"),
            F.col(f"`{fetched_at}`").alias("at"),
            F.monotonically_increasing_id().alias("nr"),
        ),
        "captures",
    )
    intervals = write_table(validity(entries), "list-intervals")

    def folded(kind: str, name: str) -> DataFrame:
        """One row for each host or URL with any interval: all its intervals in one array."""
        keys = rows.select(name).filter(F.col(name).isNotNull()).distinct()
        key = F.explode(parents(F.col(name))) if kind == "host" else F.col(name)
        return (
            keys.select(name, key.alias("key"))
            .join(intervals.filter(F.col("kind") == kind), "key")
            .groupBy(name)
            .agg(F.sort_array(F.collect_list(F.struct("list", "key", "valid_from", "valid_to"))).alias(f"{name}_intervals"))
        )

    judged = rows
    for kind, name in (("host", "host"), ("url", "page")):
        judged = salted_join(judged, write_table(folded(kind, name), f"{kind}-intervals"), name, "nr", "left")
    none = F.array().cast(_INTERVALS)
    known = F.concat(F.coalesce("host_intervals", none), F.coalesce("page_intervals", none))
    active = F.filter(
        known, lambda i: (i["valid_from"] <= F.col("at")) & (i["valid_to"].isNull() | (F.col("at") < i["valid_to"]))
    )
    lists = F.array_sort(F.array_distinct(F.transform(active, lambda i: i["list"])))
    return judged.select("row.*", F.col("host").alias("url_host"), lists.alias("url_lists")).withColumn(
        "url_listed", F.size("url_lists") > 0
    )
