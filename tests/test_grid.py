"""The whole grid at once gives what one preparation after another gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators.dedup import remove_duplicates, remove_duplicates_in_sets
from pairloom.operators.grid import language_sets
from pairloom.operators.normalize import filter_languages
from pairloom.operators.sampling import downsample_with_siblings, split_in_sets, split_two
from pairloom.plans.grid import experiment_grid, of_split, prepare_grid
from pairloom.operators.augment import augment_by_column
from pairloom.plans.prepare import augment_numbered, prepare, renumber_augmented
from pairloom.shared import fresh_path, write_table

SETS = ["es", "ko", "yo", "all"]


@pytest.fixture(scope="module")
def augmented(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        text = rng.choice(["a", "b", "c", None])
        lang = rng.choice(["en", "es", "ko", "yo", "ja", None, "xx"])
        rows.append((i, f"s{rng.randint(0, 20)}", text, i % 2, lang, i // 7))
    df = spark.createDataFrame(rows, "IDS bigint, sentence string, paraphrase string, quality int, lang string, index bigint")
    return write_table(df.repartition(5), "augmented")


def ids(df):
    return sorted(r.IDS for r in df.select("IDS").collect())


def test_duplicates_of_all_sets(augmented):
    sets = {name: language_sets()[name] for name in SETS}
    marked = write_table(remove_duplicates_in_sets(augmented, sets), "marked")
    assert marked.count() == marked.select("IDS").distinct().count()
    for name, codes in sets.items():
        own = marked.filter(F.array_contains("lang_sets", name))
        assert ids(own) == ids(remove_duplicates(filter_languages(augmented, codes)))


def test_sets_without_english_and_empty_tables(augmented):
    sets = {"one": ["es"], "two": ["es", "ko"]}
    marked = write_table(remove_duplicates_in_sets(augmented, sets), "marked")
    for name, codes in sets.items():
        own = marked.filter(F.array_contains("lang_sets", name))
        assert ids(own) == ids(remove_duplicates(filter_languages(augmented, codes)))
    assert remove_duplicates_in_sets(augmented.limit(0), sets).count() == 0
    assert split_in_sets(remove_duplicates_in_sets(augmented.limit(0), sets)).count() == 0


def test_repeated_keys_are_refused(augmented):
    with pytest.raises(ValueError, match="unique row key"):
        remove_duplicates_in_sets(augmented.withColumn("IDS", F.col("IDS") % 9), {"all": ["en", "es"]})


def test_splits_of_all_sets(augmented):
    sets = {name: language_sets()[name] for name in SETS}
    marked = write_table(remove_duplicates_in_sets(augmented, sets), "marked")
    table = split_in_sets(marked).select("IDS", "sentence", "paraphrase", "quality", "members")
    for name in sets:
        one = split_two(marked.filter(F.array_contains("lang_sets", name)))
        for split in ("train", "dev"):
            own = of_split(table, split).filter(F.col("lang_set") == name)
            assert ids(own) == ids(one.filter(F.col("split") == split))


def sources(augmented, dataset):
    plain = augmented.filter("lang = 'en'").drop("lang", "index")
    raw = plain.select("IDS", F.col("sentence").alias("c0"), F.col("paraphrase").alias("c1"), F.lit("(4, 6)").alias("c2"))
    quora = plain.select(
        F.col("IDS").alias("id"), F.col("sentence").alias("question1"), F.col("paraphrase").alias("question2"), F.col("quality").alias("is_duplicate")
    )
    mrpc = augmented.withColumnsRenamed({"sentence": "#1 String", "paraphrase": "#2 String", "quality": "Quality"})
    return {
        "mrpc": {"train": plain, "test": plain, "augmented": mrpc},
        "tpc": {"train": raw, "test": raw, "augmented": augmented, "dev": plain},
        "quora": {"all": quora, "augmented": augmented, "dev": plain, "test": plain},
    }[dataset]


@pytest.mark.parametrize("dataset,sampled", [("mrpc", False), ("tpc", False), ("quora", False)])
def test_every_set_equals_its_own_preparation(spark, augmented, dataset, sampled):
    table = prepare_grid(spark, dataset, sources(augmented, dataset), SETS, sampled)
    for name in ["baseline", "es", "all"]:
        path = fresh_path(spark, "one")
        mode = "baseline" if name == "baseline" else "augmented"
        prepare(spark, dataset, mode, sources(augmented, dataset), path, None if mode == "baseline" else language_sets()[name])
        one = spark.read.parquet(path)
        for split in ("train", "dev", "test"):
            own = of_split(table, split).filter(F.col("lang_set") == name)
            assert ids(own) == ids(one.filter(F.col("split") == split)), (name, split)


def constant(train):
    n = train.groupBy("lang_set").agg(F.max("quality").alias("pred"))
    return lambda test: test.join(F.broadcast(n), "lang_set")


def test_jobs_do_not_depend_on_the_sets(spark, augmented):
    context = spark.sparkContext

    def jobs(name, sets):
        context.setJobGroup(name, name)
        results, _ = experiment_grid(spark, {"tpc": sources(augmented, "tpc"), "mrpc": sources(augmented, "mrpc")}, {"bert": constant}, sets)
        n = results.count()
        context.setJobGroup("", "")
        assert n == 2 * (len(sets) + 1)
        return len(context.statusTracker().getJobIdsForGroup(name))

    assert jobs("few", ["es", "ko"]) == jobs("many", ["es", "ko", "yo", "ja", "zh", "te", "all"])


def test_wrong_arguments(spark, augmented):
    with pytest.raises(ValueError):
        prepare_grid(spark, "other", {}, SETS)
    with pytest.raises(KeyError):
        prepare_grid(spark, "tpc", sources(augmented, "tpc"), ["nowhere"])


def test_numbered_translations(spark):
    """The numbers are those of a sort of all copies, and only the English rows are sorted."""
    rows = [(i, f"s{i}", None if i % 5 == 0 else f"T{i}", i % 2) for i in (9, 4, 30, 5, 12)]
    english = spark.createDataFrame(rows, "IDS bigint, sentence string, paraphrase string, quality int")
    rule = lambda text, lang: F.concat(lang, text)
    found = augment_numbered(english, rule, ["ko", "es"])
    want = renumber_augmented(augment_by_column(english, rule, ["ko", "es"]), ["ko", "es"]).select(found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert "rangepartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_table_is_not_stored_again(spark, augmented, monkeypatch):
    stored = []
    monkeypatch.setattr("pairloom.plans.grid.write_table", lambda df, name: stored.append(name) or write_table(df, name))
    prepare_grid(spark, "tpc", sources(augmented, "tpc"), SETS)
    assert "grid-augmented" not in stored


@pytest.mark.parametrize("pairs", [0, 10**6])
def test_duplicates_of_a_part(augmented, monkeypatch, pairs):
    """A part's rows stay in the sets in which they stay in the whole table."""
    monkeypatch.setattr("pairloom.operators.dedup.BROADCAST_PAIRS", pairs)
    sets = {name: language_sets()[name] for name in SETS}
    whole = {r.IDS: sorted(r.lang_sets) for r in remove_duplicates_in_sets(augmented, sets).collect()}
    for part in ("index % 3 = 1", "lang = 'es'", "lang = 'en'", "IDS < 0"):
        chosen = write_table(augmented.filter(part), "part")
        found = remove_duplicates_in_sets(augmented, sets, part=chosen).collect()
        own = set(ids(chosen))
        assert {r.IDS: sorted(r.lang_sets) for r in found} == {k: v for k, v in whole.items() if k in own}


def test_a_sampled_grid_stores_the_sample_alone(spark, monkeypatch):
    """The sample is drawn before duplicates are removed; members are those of the old order."""
    rng = random.Random(8)
    rows = [
        (i * 5 + k, f"s{rng.randint(0, 90)}", rng.choice(["a", "b", None]), i % 2, lang, i)
        for i in range(600)
        for k, lang in enumerate(["en", "es", "ko", None, "yo"])
    ]
    df = write_table(spark.createDataFrame(rows, "IDS bigint, sentence string, paraphrase string, quality int, lang string, index bigint"), "many")
    sets = {name: language_sets()[name] for name in SETS}
    want = split_in_sets(write_table(downsample_with_siblings(write_table(remove_duplicates_in_sets(df, sets), "clean")), "sample"))
    stored = {}
    monkeypatch.setattr("pairloom.plans.grid.write_table", lambda t, name: stored.setdefault(name, write_table(t, name)))
    table = prepare_grid(spark, "mrpc", sources(df, "mrpc"), SETS, downsample=True)
    for split in ("train", "dev"):
        own = of_split(table, split).filter("lang_set <> 'baseline'").select("IDS", "lang_set")
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, of_split(want, split).select("IDS", "lang_set").collect()))
    assert stored["grid-sample"].count() <= 100 * 5 and stored["grid-clean"].count() <= 100 * 5


def test_datasets_share_training_rows(spark, augmented, monkeypatch):
    """One augmented corpus is freed from duplicates once for all datasets, and is not read for test rows."""
    stored = []
    monkeypatch.setattr("pairloom.plans.grid.write_table", lambda df, name: stored.append(name) or write_table(df, name))
    made = {}
    tables = [prepare_grid(spark, dataset, sources(augmented, dataset), SETS, made=made) for dataset in ("tpc", "quora")]
    assert stored == ["grid-clean"]
    for table in tables:
        plans = [of_split(table, s)._jdf.queryExecution().executedPlan().toString() for s in ("train", "test")]
        assert "lang_sets" in plans[0] and "lang_sets" not in plans[1]
