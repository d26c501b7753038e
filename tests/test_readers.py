from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.operators.normalize import normalize_twitter
from pairloom.sources import readers, writers


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, body in files.items():
        (folder / name).write_bytes(body.encode("utf8"))
    return str(folder)


def test_tsv_lines(spark, tmp_path):
    body = "Quality\t#1 ID\t#2 ID\t#1 String\t#2 String\n1\t10\t11\ta \"q\tb\n\t0\t5\t6\tx\ty\n0\t1\t2\tonly\n1\t1\t2\tx\t\n"
    path = put(tmp_path / "d", a=body)
    rows = readers.read_tsv_pairs(spark, path).orderBy("IDS").collect()
    # A leading tab goes with the strip, so the label of the second line is its next field.
    assert [tuple(r) for r in rows] == [
        (0, 'a "q', "b", 1),
        (1, "x", "y", 0),
        (2, "only", None, 0),
        (3, "x", None, 1),
    ]
    assert [r.IDS for r in readers.read_tsv_rejects(spark, path).orderBy("IDS").collect()] == [2, 3]


def test_bad_label_fails(spark, tmp_path):
    path = put(tmp_path / "d", a="h\nx\t1\t2\ta\tb\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.read_tsv_pairs(spark, path).collect()
    assert readers.read_tsv_rejects(spark, path).count() == 1


def test_line_numbers_over_many_files_and_blocks(spark, tmp_path):
    lines = [f"1\t{i}\t{i}\ts{i}\tp{i}" for i in range(3000)]
    files = {}
    for k in range(3):
        files[f"part{k}"] = "\n".join(["header", *lines[k * 1000 : (k + 1) * 1000]]) + "\n"
    path = put(tmp_path / "d", **files)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "512")
        df = readers.read_tsv_pairs(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        rows = df.orderBy("IDS").collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert [r.IDS for r in rows] == list(range(3000))
    assert [r.sentence for r in rows] == [f"s{i}" for i in range(3000)]


def test_cells(spark, tmp_path):
    path = put(tmp_path / "d", a="\ufeffa\tb\n\"c\td\"\te\n")
    cells = [r.cells for r in readers.read_tsv_cells(spark, path).orderBy("IDS").collect()]
    assert cells == [["a", "b"], ['"c', 'd"', "e"]]
    quoted = readers.read_tsv_cells(spark, path, quote='"', columns=3).orderBy("IDS")
    assert [r.cells for r in quoted.collect()] == [["a", "b"], ["c\td", "e"]]
    gaps = put(tmp_path / "gaps", a="a\t\tb\n\n\t\"\"\n")
    cells = [r.cells for r in readers.read_tsv_cells(spark, gaps).orderBy("IDS").collect()]
    assert cells == [["a", "", "b"], [], ["", '""']]
    quoted = readers.read_tsv_cells(spark, gaps, quote='"', columns=4).orderBy("IDS")
    assert [r.cells for r in quoted.collect()] == [["a", "", "b"], []]


def test_quoted_rows(spark, tmp_path):
    body = '"a\tb"\t"c ""d""\ne"\t(4, 6)\tu\nNA\tx\t(3, 6)\tu\nnull\t""\t(2, 6)\tu\n'
    path = put(tmp_path / "d", a=body)
    rows = readers.read_tsv_quoted(spark, path).orderBy("IDS")
    assert [tuple(r) for r in rows.collect()] == [
        (0, "a\tb", 'c "d"\ne', "(4, 6)", "u"),
        (1, None, "x", "(3, 6)", "u"),
        (2, None, None, "(2, 6)", "u"),
    ]
    found = normalize_twitter(rows).orderBy("IDS").collect()
    assert [(r.IDS, r.quality) for r in found] == [(0, 1), (2, 0)]


def test_csv_by_name(spark, tmp_path):
    body = ',lang,sentence,paraphrase,quality,IDS,index,extra\n0,en,"a, ""b""","x\ny",1,7,9007199254740993.0,z\n1,es,NA,p,0,7,,z\n'
    path = put(tmp_path / "d", a=body)
    rows = readers.read_csv_pairs(spark, path)
    assert rows.schema.names == schemas.AUGMENTED.names
    assert sorted(map(tuple, rows.collect()), key=repr) == [
        (7, 'a, "b"', "x\ny", 1, "en", 9007199254740993),
        (7, None, "p", 0, "es", None),
    ]
    again = readers.read_csv_pairs(spark, path, renumber=True).orderBy("IDS").collect()
    assert [(r.IDS, r.lang) for r in again] == [(0, "en"), (1, "es")]


def test_split_files_round_trip(spark, tmp_path):
    rows = [(0, 'say "hi"\nnow', None, 1, "train"), (1, "NA", "b", 0, "dev"), (2, "c", "d", 0, "test"), (3, "e", "", 1, "train")]
    df = spark.createDataFrame(rows, "IDS bigint, sentence string, paraphrase string, quality int, split string")
    path = str(tmp_path / "parquet")
    assert writers.write_splits(df, path) == {"train": 2, "dev": 1, "test": 1}
    train = readers.read_split(spark, path, "train").orderBy("guid").collect()
    assert [tuple(r) for r in train] == [(0, 'say "hi"\nnow', None, 1), (3, "e", "", 1)]
    # Parquet keeps a text that a CSV reader would take for a missing value.
    assert readers.read_split(spark, path, "dev", examples=False).first().sentence == "NA"
    assert "PartitionFilters: [isnotnull(split" in readers.read_split(spark, path, "dev")._jdf.queryExecution().toString()
    assert writers.write_splits(df, str(tmp_path / "csv"), "csv") == {"train": 2, "dev": 1, "test": 1}
    back = readers.read_csv_pairs(spark, str(tmp_path / "csv" / "split=train"), schemas.PAIRS)
    assert back.filter(F.col("IDS") == 0).first().sentence == 'say "hi"\nnow'
    with pytest.raises(ValueError):
        readers.read_split(spark, path, "valid")


def test_cached_features(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    ask = lambda **kw: writers.cached_features(spark, str(tmp_path), "dev", "bert", 128, make, **kw).count()
    assert [ask(), ask(), ask(reprocess=True), ask()] == [1, 1, 2, 2]
