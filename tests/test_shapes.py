"""The shuffles, pushed filters and pruned columns of the main operators."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pairloom.operators import augment, features, grid, metrics, normalize, sampling
from pairloom.operators.dedup import remove_duplicates
from pairloom.operators.keys import file_row_index
from pairloom.shared import write_table


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.range(2000).select(
        F.col("id").alias("IDS"),
        F.format_string("s%d one", F.col("id") % 900).alias("sentence"),
        F.format_string("p%d two", F.col("id") % 900).alias("paraphrase"),
        (F.col("id") % 2).cast("int").alias("quality"),
        F.when(F.col("id") % 3 == 0, F.lit("en")).otherwise(F.lit("es")).alias("lang"),
        (F.col("id") % 900).alias("index"),
    )
    return write_table(df, "shapes")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^,)]*|rangepartitioning|SinglePartition)", plan(df))


def columns_read(df) -> set[str]:
    return set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan(df)))))


def test_splits_and_samples_do_not_shuffle(corpus):
    for made in (sampling.split_two(corpus), sampling.split_three(corpus), sampling.balanced_sample(corpus)):
        assert shuffles(made) == [] and "Window" not in plan(made) and "Sort" not in plan(made)
    assert columns_read(sampling.split_two(corpus).select("IDS", "split")) == {"IDS"}


def test_duplicates_use_hash_aggregates_and_leave_english_rows(corpus):
    made = remove_duplicates(corpus, check=False)
    text = plan(made)
    assert "SortAggregate" not in text and "HashAggregate" in text and "partial_min" in text
    # only the pair and its keys are aggregated; other columns move with foreign rows alone
    aggregates = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", text)
    assert all("quality" not in a and "index" not in a for a in aggregates)
    english = text[: text.index("BroadcastHashJoin")] if "BroadcastHashJoin" in text else text[: text.index("SortMergeJoin")]
    assert "Exchange" not in english


def test_numbering_a_file_does_not_shuffle_its_lines(spark, tmp_path):
    spark.range(2000).select(F.concat(F.lit("line "), "id")).repartition(4).write.text(str(tmp_path / "lines"))
    made = file_row_index(spark.read.text(str(tmp_path / "lines")))
    assert shuffles(made) == [] and "BroadcastHashJoin" in plan(made)


def test_normalisers_are_narrow_and_push_filters(corpus):
    made = normalize.filter_languages(corpus, ["es", "ja"])
    assert shuffles(made) == []
    assert re.search(r"PushedFilters: \[[^\n]*lang", plan(made))
    raw = corpus.selectExpr("IDS AS id", "sentence AS question1", "paraphrase AS question2", "quality AS is_duplicate")
    assert shuffles(normalize.normalize_quora(raw)) == []


def test_fan_out_is_an_explode(corpus):
    made = augment.augment_by_column(corpus.drop("lang", "index"), lambda t, c: F.upper(t))
    assert shuffles(made) == [] and "Join" not in plan(made)


def test_encoding_moves_each_row_once(spark, corpus):
    vocabulary = write_table(features.build_vocabulary(corpus), "vocabulary")
    made = features.encode_pairs(corpus, vocabulary)
    assert len(shuffles(made)) == 1 and "BroadcastHashJoin" in plan(made)


def test_metrics_combine_before_the_shuffle(corpus):
    preds = corpus.select("lang", F.col("quality").alias("gold"), F.lit(1).alias("pred"))
    made = metrics.evaluate_runs(preds, "lang")
    assert len(shuffles(made)) == 1 and "partial_sum" in plan(made)
    assert columns_read(made) == {"lang", "quality"}


def test_grids_count_before_they_expand(spark, corpus):
    sets = grid.language_set_table(spark)
    made = plan(grid.grid_sizes(corpus, grid.run_grid(spark), sets))
    below_join = made[made.rindex("BroadcastHashJoin") :]
    assert "partial_count" in below_join
    assert "CartesianProduct" not in made and "NestedLoop" not in made


def test_leaderboard_reads_the_results_once(spark):
    names = ["accuracy"]
    results = spark.createDataFrame([("d", "m", "baseline", 0.5)], ["dataset", "model", "langs", *names])
    assert len(shuffles(grid.leaderboard(write_table(results, "results"), metrics=names))) <= 2
