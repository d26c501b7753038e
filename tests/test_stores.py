"""Answers, records, reports and rejects: nothing is asked, counted or lost twice."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from pairloom.operators.augment import batch_round_trips
from pairloom.operators.scoring import score_pairs
from pairloom.plans.augment import augment
from pairloom.shared import committed_parts, fresh_path
from pairloom.sources import readers, writers
from pairloom.sources.answers import AnswerStore


def service_with(folder):
    """A service that notes every text it is asked for."""

    def service(texts, lang, to_foreign):
        with open(f"{folder}/{os.getpid()}-{time.time_ns()}", "w") as f:
            f.write("\n".join(f"{lang} {to_foreign} {t}" for t in texts))
        if any("poison" in t for t in texts):
            raise RuntimeError("the service is down")
        return [f"{lang}:{t}" if to_foreign else t.split(":", 1)[1].upper() for t in texts]

    return service


def asked(folder):
    return sorted(line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().split("\n"))


def pairs_of(spark, texts):
    rows = [(i, f"s{i}", t, i % 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "IDS bigint, sentence string, paraphrase string, quality int").repartition(3)


def trips(df):
    return sorted(map(tuple, df.collect()))


def test_second_run_asks_for_new_texts_only(spark, tmp_path):
    store, service = AnswerStore(spark, fresh_path(spark, "answers")), service_with(tmp_path)
    texts = [f"t{i % 30}" for i in range(60)] + [None, ""]
    first = batch_round_trips(pairs_of(spark, texts), service, ["es", "yo"], answers=store)
    assert len(asked(tmp_path)) == 31 * 2 * 2
    assert trips(first) == trips(batch_round_trips(pairs_of(spark, texts), service, ["es", "yo"]))
    before = len(asked(tmp_path))
    more = batch_round_trips(pairs_of(spark, [*texts, "new 1", "new 2"]), service, ["es", "yo"], answers=store)
    assert len(asked(tmp_path)) - before == 2 * 2 * 2
    assert ("new 1", "es", "NEW 1") in trips(more)


def test_killed_run_keeps_its_committed_waves(spark, tmp_path):
    path, service = fresh_path(spark, "answers"), service_with(tmp_path)
    store = AnswerStore(spark, path, wave=5)
    texts = [f"t{i}" for i in range(40)]
    with pytest.raises(Exception, match="service is down"):
        batch_round_trips(pairs_of(spark, [*texts, "poison"]), service, ["es"], batch=1, answers=store)
    kept = store.answers().count()
    assert 0 <= kept < 41 and kept == sum(
        spark.read.parquet(f"{path}/version-{v}").count() for v in committed_parts(spark, path, "version", "-")
    )
    before = len(asked(tmp_path))
    batch_round_trips(pairs_of(spark, texts), service, ["es"], batch=1, answers=store)
    assert len(asked(tmp_path)) - before == (40 - kept) + 40


def test_compaction_and_conflicting_answers(spark):
    store = AnswerStore(spark, fresh_path(spark, "answers"))
    assert store.answers().collect() == []
    store.compact()
    texts = spark.createDataFrame([("a", "es"), ("b", "es"), ("a", "yo"), (None, "yo"), ("a", "es")], "text string, lang string")
    got = store.ask(texts, True, lambda t, lang: [f"{lang}-{x}" for x in t], 2)
    assert trips(got) == [("a", "es", "es-a"), ("a", "yo", "yo-a"), ("b", "es", "es-b")]
    # Another writer has answered the same question otherwise: the smallest answer counts.
    other = store.answers().filter("lang = 'yo'").withColumn("answer", F.lit("aaa")).drop("version")
    other.write.parquet(f"{store.path}/version-7")
    store.compact()
    assert store._parts() == (7, [])
    never = lambda t, lang: pytest.fail("asked again")
    assert trips(store.ask(texts, True, never, 2)) == [("a", "es", "es-a"), ("a", "yo", "aaa"), ("b", "es", "es-b")]
    store.ask(spark.createDataFrame([("c", "es")], "text string, lang string"), True, lambda t, lang: ["C"], 2)
    assert store._parts() == (7, [8])
    store.compact()
    assert store._parts() == (8, []) and store.answers().count() == 4


def test_augment_job_with_a_store(spark, tmp_path):
    pairs, service, answers = pairs_of(spark, ["a", "b", None, "a"]), service_with(tmp_path), fresh_path(spark, "answers")
    out = [augment(pairs, fresh_path(spark, "out"), ["es"], service=service, answers=answers) for _ in range(2)]
    plain = augment(pairs, fresh_path(spark, "out"), ["es"], service=lambda t, lang, f: [x if f else x.upper() for x in t])
    assert len(asked(tmp_path)) == 4
    rows = [sorted((r.IDS, r.lang, r.paraphrase or "") for r in df.collect()) for df in (*out, plain)]
    assert rows[0] == rows[1] == rows[2]


RECORD = "config struct<model:string,langs:string,dataset:string>, results struct<accuracy:double>"


def test_records_count_once(spark):
    path = fresh_path(spark, "records")
    assert writers.read_records(spark, path, RECORD).count() == 0

    def record(model, value):
        return spark.createDataFrame([((model, "es", "tpc"), (value,))], RECORD)

    writers.append_records(record("bert", 0.5), path)
    writers.append_records(record("xlnet", 0.25), path)
    broken = record("bert", 0.0).withColumn("results", F.when(F.rand() < 2, F.raise_error(F.lit("stop"))).cast("struct<accuracy:double>"))
    with pytest.raises(Exception, match="stop"):
        writers.append_records(broken, path)
    # What a failed attempt leaves behind is not read.
    record("bert", 0.9).withColumn("dataset", F.lit("tpc")).write.partitionBy("dataset").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").json(f"{path}/attempt=9")
    writers.append_records(record("bert", 0.75), path)
    got = {r.config.model: r.results.accuracy for r in writers.read_records(spark, path, spark.createDataFrame([], RECORD).schema).collect()}
    assert got == {"bert": 0.75, "xlnet": 0.25}


def test_report_is_ordered_and_replaced(spark, tmp_path):
    path = str(tmp_path / "report.txt")
    rows = spark.createDataFrame([("b", 2, "two"), ("a", 9, "nine"), ("a", 1, "one = 1"), ("c", 0, "é")], "m string, k int, line string")
    writers.write_report(rows.repartition(4), path, "m", "k")
    assert open(path, encoding="utf-8").read().split("\n") == ["one = 1", "nine", "two", "é", ""]
    writers.write_report(rows.filter("m = 'b'"), path, "m", "k")
    assert open(path, encoding="utf-8").read() == "two\n"
    writers.write_report(rows.filter("m = 'z'"), path, "m", "k")
    assert open(path, encoding="utf-8").read() == ""
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".")] == ["report.txt"]


def test_good_and_bad_lines(spark, tmp_path):
    lines = ["Quality\t#1\t#2\ts\tp", "1\t1\t2\ta\tb", "x\t1\t2\ta\tb", "0\t1\t2\tonly", "", "\t0\t1\t2\ta", "0\t3\t4\tc\td\textra"]
    (tmp_path / "f.txt").write_text("\n".join(lines))
    good, bad = readers.read_tsv_checked(spark, str(tmp_path))
    assert sorted(map(tuple, good.collect())) == [(0, "a", "b", 1), (5, "c", "d", 0)]
    assert sorted(map(tuple, bad.collect())) == [(1, "label", lines[2]), (2, "paraphrase", lines[3]), (3, "label", ""), (4, "paraphrase", lines[5])]
    assert sorted(r.IDS for r in readers.read_tsv_rejects(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
    for part in (good, bad):  # both read what the one scan has stored
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "text" not in plan.split("FileScan")[1].split("[")[0]


def test_a_worker_loads_its_model_once(spark, tmp_path):
    weights, loads = tmp_path / "w.txt", tmp_path / "loads"
    weights.write_text("3")
    loads.mkdir()
    folder = str(loads)

    def load(path):
        factor = float(open(path).read())
        open(f"{folder}/{os.getpid()}-{time.time_ns()}", "w").close()
        return lambda chunk: (chunk[["sentence", "paraphrase"]].map(len) * factor).to_numpy().tolist()

    rows = pairs_of(spark, [f"p{i}" for i in range(500)]).repartition(50)
    got = score_pairs(rows, load, version="one", weights=f"file://{weights}")
    assert got.rdd.getNumPartitions() == 50
    assert {tuple(r.logits) for r in got.filter("IDS < 10").collect()} == {(6.0, 6.0)}
    got.collect()
    workers = {n.split("-")[0] for n in os.listdir(loads)}
    assert len(os.listdir(loads)) == len(workers) <= 16
    score_pairs(rows, load, version="two", weights=f"file://{weights}").collect()
    assert len(os.listdir(loads)) <= 2 * 16
