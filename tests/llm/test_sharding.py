"""Bounded-load sharding against a plain walk of the ring, and the edge cases of its rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.llm.sharding import assign_shards


def place(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def walked(rows, shards, nodes, load):
    """(key, shard, slot) of rows (key, group), by laps over the virtual nodes."""
    ring = sorted((place(f"shard/{i % shards}/{i // shards}"), i % shards) for i in range(shards * nodes))
    waiting = sorted(rows, key=lambda r: (place(r[1] or ""), r[0] is not None, r[0] or 0))
    n = len(rows)
    room = [n // shards + (s < n % shards) if load is None else -int(-load * n // shards) for s in range(shards)]
    slots, out, done = [0] * shards, [], 0
    for lap in range(2):
        for at, shard in ring:
            while done < n and (lap or place(waiting[done][1] or "") <= at) and slots[shard] < room[shard]:
                out.append((waiting[done][0], shard, slots[shard]))
                slots[shard] += 1
                done += 1
    assert done == n
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def assigned(docs, *args, **kw):
    return [(r.doc_id, r.shard, r.slot) for r in assign_shards(docs, *args, **kw).collect()]


TEXTS = [None, "", "one", *["the same text"] * 40, *[f"text {i % 50}" for i in range(150)], "é" * 1000]


@pytest.mark.parametrize("shards,nodes,load", [(5, 8, None), (24, 64, None), (7, 3, 1.25), (1, 1, None), (300, 2, 1.0)])
def test_against_plain_walk(docs_of, shards, nodes, load):
    rows = list(enumerate(TEXTS))
    want = walked([(i, t) for i, t in rows], shards, nodes, load)
    assert order(assigned(docs_of(TEXTS), shards, nodes=nodes, load=load)) == order(want)


def test_balance_slots_and_columns(docs_of):
    got = assign_shards(docs_of(TEXTS, 7), 9)
    rows = got.collect()
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(rows) == len(TEXTS)
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_partitions_do_not_matter(docs_of):
    assert order(assigned(docs_of(TEXTS, 1), 6)) == order(assigned(docs_of(TEXTS, 11), 6))


def test_equal_texts_stay_together(docs_of):
    rows = assigned(docs_of([f"text {i // 4}" for i in range(800)]), 8)
    shards = {}
    for key, shard, _ in rows:
        shards.setdefault(key // 4, set()).add(shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 8 * 2 * 2


def test_few_rows_move(docs_of):
    """One shard more: with room to spare about a tenth of the rows moves, as it must."""
    docs = docs_of([f"text {i}" for i in range(3000)])
    share = {}
    for load in (None, 1.25):
        before, after = (dict((k, s) for k, s, _ in assigned(docs, n, load=load)) for n in (9, 10))
        share[load] = sum(before[k] != after[k] for k in before) / len(before)
    assert share[1.25] < 0.25 and share[None] < 0.6


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (1, ""), (2, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {c: F.lit("x") for c in ("size", "shard", "slot", "_place", "_at", "_key", "Text_CRC32")}
    )
    got = assign_shards(docs, 4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert sorted(Counter(r.shard for r in got).values()) == [1, 1, 2, 2]


def test_empty_table_and_wrong_arguments(docs_of):
    assert assigned(docs_of([]), 5) == []
    with pytest.raises(ValueError):
        assign_shards(docs_of(["a"]), 0)
    with pytest.raises(ValueError):
        assign_shards(docs_of(["a"]), 2, load=0.5)


def test_group_column(docs_of):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", 1) for i in range(30)]
    got = assigned(docs_of(rows), 4, group="source")
    assert order(got) == order(walked([(i, f"s{i % 3}") for i in range(30)], 4, 64, None))


def test_no_python_in_the_plan(docs_of):
    plan = assign_shards(docs_of(TEXTS), 4)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
