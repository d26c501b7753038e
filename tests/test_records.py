"""Quoted files by records give what Spark's own reader gives in one task."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairloom.sources import readers
from pairloom.sources.records import quoted_records

SCHEMA = "c0 string, c1 string, c2 string"
OPTIONS = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": "true"}


@pytest.fixture()
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def in_order(scan):
    marked = scan.select("*", F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_m")).orderBy("_f", "_m")
    return [tuple(r)[:-2] for r in marked.collect()]


def parsed(spark, folder):
    rows, _ = quoted_records(spark, str(folder), "\t")
    got = rows.select("IDS", F.from_csv("record", SCHEMA, OPTIONS).alias("r")).select("IDS", "r.*").orderBy("IDS").collect()
    assert [r.IDS for r in got] == list(range(len(got)))
    return [tuple(r)[1:] for r in got]


def random_file(rng, end):
    out = ""
    for _ in range(rng.randint(0, 80)):
        cells = []
        for _ in range(3):
            kind = rng.randint(0, 7)
            v = "".join(rng.choice(["a", " ", "é", '"', "\t", end, end]) for _ in range(rng.randint(0, 12)))
            if kind < 5:
                cells.append('"' + v.replace('"', '""') + '"')
            elif kind == 5:  # quotes inside a field without quoting are plain characters
                cells.append("x" + "".join(c for c in v if c not in "\t\r\n"))
            else:
                cells.append("".join(c for c in v if c in "aé "))
        out += "\t".join(cells) + end
        out += end if rng.random() < 0.1 else ""
    return out[: -len(end)] if out and rng.random() < 0.4 else out


@pytest.mark.parametrize("seed", range(4))
def test_random_files(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    for f in range(3):
        (tmp_path / f"f{f}.txt").write_bytes(random_file(rng, rng.choice(["\n", "\r\n"])).encode())
    want = in_order(spark.read.schema(SCHEMA).options(**OPTIONS).csv(str(tmp_path)))
    assert parsed(spark, tmp_path) == want


def test_planted_cases(spark, tmp_path, small_splits):
    lines = [
        '5\' 10" tall\tb"c\td',  # an odd quote amid a field
        '"a\n\n\nb"\t""\t"""x"""',
        '"' + 'long ""quoted"" text\n' * 60 + '"\tb\tc',  # longer than several blocks
        "\n",
        '"closed"junk"\tb\tc',
        "last\twithout\tend",
    ]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text('"﻿"\t2\t3\n')
    (tmp_path / "empty.txt").write_text("")
    want = in_order(spark.read.schema(SCHEMA).options(**OPTIONS).csv(str(tmp_path)))
    assert parsed(spark, tmp_path) == want and len(want) == 6


def test_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_text('"x\ny"\t"z"\t\n' * 500)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 5
    assert parsed(spark, tmp_path) == [("x\ny", "z", None)] * 500


def test_reader_chooses_by_size(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_text('"x\ny"\t"z"\t"(1, 2)"\tu\n' * 50)
    assert readers._by_records(spark, str(tmp_path), '"', None)
    rows = {m: sorted(map(tuple, readers.read_tsv_quoted(spark, str(tmp_path), multi_line=m).collect())) for m in (None, True, "records")}
    assert rows[None] == rows[True] == rows["records"] and len(rows[None]) == 50
    with pytest.raises(ValueError):
        readers.read_tsv_quoted(spark, str(tmp_path), multi_line="lines")
    cells = readers.read_tsv_cells(spark, str(tmp_path), quote='"', columns=4).collect()
    assert len(cells) == 50 and cells[0].cells == ["x\ny", "z", "(1, 2)", "u"]


def test_csv_with_headers(spark, tmp_path, small_splits):
    for name, n in (("a", 40), ("b", 0), ("c", 25)):
        body = "".join(f'{i},{name}{i},"p,\n""{i}""",{i % 2},en,{i}.0\n' for i in range(n))
        (tmp_path / f"{name}.csv").write_text("Unnamed: 0,sentence,paraphrase,quality,lang,index\n" + body)
    for renumber in (True, False):
        got, want = (
            sorted(map(tuple, readers.read_csv_pairs(spark, str(tmp_path), renumber=renumber, multi_line=m).collect()))
            for m in ("records", True)
        )
        assert got == want and len(got) == 65
    (tmp_path / "d.csv").write_text("Unnamed: 0,paraphrase,sentence,quality,lang,index\n1,a,b,1,en,0\n")
    with pytest.raises(ValueError, match="headers"):
        readers.read_csv_pairs(spark, str(tmp_path), multi_line="records")


def test_headers_alone_are_moved(spark, tmp_path, small_splits):
    """Headers of no, one and many blocks, blank lines before them, and files without other records."""
    long = '"' + "x\n" * 400 + '",b'
    files = {"a": "a,b\n" + "1,2\n" * 500, "b": long + "\n" + "1,2\n" * 500, "c": "\n" * 700 + "a,b\n3,4", "d": long, "e": "", "f": "a,b\n" + '"' + "y\n" * 900 + '",z'}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    rows, heads = quoted_records(spark, str(tmp_path), ",", header=True)
    long = '"' + "x\n" * 400 + '",b'
    assert sorted(r.record for r in heads.collect()) == sorted(["a,b", "a,b", "a,b", long, long])
    assert rows.count() == 500 + 500 + 1 + 1
    assert sorted(r.IDS for r in rows.collect()) == list(range(1002))
    plan = heads._jdf.queryExecution().optimizedPlan().toString().splitlines()
    moved = [i for i, line in enumerate(plan) if "_stop" in line and "isnull" in line and "value" not in line]
    assert moved and min(i for i, line in enumerate(plan) if "Window" in line) < max(moved)  # below the windows
