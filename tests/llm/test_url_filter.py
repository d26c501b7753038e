from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pairloom.llm.url_filter import filter_urls, parents, validity

DAY0 = datetime(2024, 1, 1)
ENTRY = "list string, kind string, key string, action string, effective_at timestamp"
CAPTURE = "id bigint, url string, fetched_at timestamp, url_host string, host string"


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def listed(entries, kind, key, name, at):
    """Replay of one list's entries up to an instant."""
    state = False
    known = [e for e in entries if e[0] == name and e[1] == kind and e[2] == key and e[4] is not None and e[4] <= at]
    for e in sorted(known, key=lambda e: (e[4], e[3] == "remove")):
        state = e[3] == "add" if e[3] in ("add", "remove") else state
    return state


def brute(capture, entries):
    _, url, at = capture
    if url is None or at is None or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].rstrip(".").lower()
    page = host + ("/" + rest.split("/", 1)[1].split("?")[0].split("#")[0] if "/" in rest else "").rstrip("/")
    hosts = [host[i:] for i in [0] + [i + 1 for i, c in enumerate(host) if c == "."]]
    names = {e[0] for e in entries if e[0]}
    return sorted(
        n for n in names if any(listed(entries, "host", h, n, at) for h in hosts) or listed(entries, "url", page, n, at)
    )


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "M.b.org", "c.net"]
    entries = [
        (rng.choice(["spam", "porn"]), "host", rng.choice(hosts).lower(), rng.choice(["add", "remove"]), day(rng.randrange(30)))
        for _ in range(60)
    ]
    entries += [("bad", "url", "a.com/p/q", "add", day(3)), ("bad", "url", "a.com/p/q", "remove", day(9))]
    entries += [entries[0], (None, "host", "a.com", "add", day(0)), ("spam", "host", None, "add", day(0))]
    entries += [("spam", "what", "a.com", "add", day(0)), ("spam", "host", "c.net", "add", None), ("spam", "host", "c.net", "x", day(0))]
    entries += [("tie", "host", "c.net", "add", day(5)), ("tie", "host", "c.net", "remove", day(5)), ("tie", "host", "c.net", "add", day(6))]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/p/q", "/p/q/?a=1#b", ":80/p")]
    urls += ["https://u:pw@A.com./p/q", "no url", "", None, "ftp://", "http://x.a.com?x"]
    captures = [(i, rng.choice(urls), day(rng.choice([None, *range(31)]))) for i in range(400)]
    captures += [(900, "http://a.com/p/q", day(3)), (901, "http://a.com/p/q", day(9)), (900, "http://a.com/p/q", day(3))]
    return captures, entries


def test_against_replay(spark, data, monkeypatch):
    captures, entries = data
    df = spark.createDataFrame([(*c, "clash", "h") for c in captures], CAPTURE).repartition(3)
    out = filter_urls(df, spark.createDataFrame(entries, ENTRY))
    assert out.columns == ["id", "url", "fetched_at", "host", "url_host", "url_lists", "url_listed"]
    got = sorted((r.id, r.url, r.url_lists, r.url_listed) for r in out.collect() if r.url is not None)
    want = sorted((c[0], c[1], brute(c, entries), bool(brute(c, entries))) for c in captures if c[1] is not None)
    assert got == want
    assert all(not r.url_listed for r in out.collect() if r.url is None)
    assert len({tuple(w[2]) for w in want}) > 3


def test_intervals_do_not_touch(spark, data):
    rows = validity(spark.createDataFrame(data[1], ENTRY)).orderBy("list", "kind", "key", "valid_from").collect()
    for a, b in zip(rows, rows[1:]):
        if a[:3] == b[:3]:
            assert a.valid_to < b.valid_from


def test_empty(spark, data):
    captures = spark.createDataFrame([(*c, "x", "h") for c in data[0]], CAPTURE)
    none = spark.createDataFrame([], ENTRY)
    assert filter_urls(captures, none).filter("url_listed OR size(url_lists) > 0").count() == 0
    assert filter_urls(captures.limit(0), spark.createDataFrame(data[1], ENTRY)).count() == 0


def test_no_python_in_the_plan(spark, data):
    df = spark.createDataFrame([(*c, "x", "h") for c in data[0]], CAPTURE)
    plan = filter_urls(df, spark.createDataFrame(data[1], ENTRY))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_addresses_have_no_parents(spark):
    hosts = ["10.0.0.1", "a.10.0.0.1", "x.b.com", "1.2.3", "[2001:db8::1]"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", parents(F.col("host")).alias("p")).collect()
    assert {r.host: r.p for r in rows} == {
        "10.0.0.1": ["10.0.0.1"],
        "a.10.0.0.1": ["a.10.0.0.1", "10.0.0.1", "0.0.1", "0.1", "1"],
        "x.b.com": ["x.b.com", "b.com", "com"],
        "1.2.3": ["1.2.3", "2.3", "3"],
        "[2001:db8::1]": ["[2001:db8::1]"],
    }
