"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import views
from pairloom.constants import METRICS, TARGET_LANGUAGES
from pairloom.functions import labels, text
from pairloom.operators import (
    augment,
    batches,
    features,
    grid,
    keys,
    metrics,
    normalize,
    sampling,
    scoring,
)
from pairloom.operators.dedup import remove_duplicates
from pairloom.plans.augment import augment as store_augmented
from pairloom.plans.augment import untranslated_rows
from pairloom.plans.experiment import evaluate, experiment, prepared
from pairloom.plans.grid import experiment_grid as run_whole_grid
from pairloom.plans.grid import of_split, prepare_grid
from pairloom.plans.prepare import augment_numbered, prepare, renumber_augmented
from pairloom.plans import training
from pairloom.shared import fresh_path, write_table
from pairloom.sources import readers, writers
from pairloom.sources.answers import AnswerStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PAIR = ("IDS", "sentence", "paraphrase", "quality")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, *by: str, names: list[str] = METRICS) -> DataFrame:
    return df.select(*by, *[F.round(F.col(f"`{m}`"), 6).alias(m.lower().replace("-", "_")) for m in names])


# Sources -----------------------------------------------------------------


@query
def src_tsv_pairs(spark, sf_dir):
    path = views.write_mrpc_file(spark, views.pairs(spark, sf_dir))
    return readers.read_tsv_pairs(spark, path)


def _with_bad_lines(spark, sf_dir) -> str:
    """The raw file with labels that are no numbers in one line of 97; some lines lack a paraphrase as it is."""
    bad = F.when(F.col("IDS") % 97 == 0, F.concat(F.lit("n/a "), "quality")).otherwise(F.col("quality").cast("string"))
    return views.write_mrpc_file(spark, views.pairs(spark, sf_dir).withColumn("quality", bad))


@query
def src_tsv_rejects(spark, sf_dir):
    return readers.read_tsv_checked(spark, _with_bad_lines(spark, sf_dir))[1]


@query
def src_tsv_checked(spark, sf_dir):
    return readers.read_tsv_checked(spark, _with_bad_lines(spark, sf_dir))[0]


@query
def src_tsv_cells(spark, sf_dir):
    path = views.write_mrpc_file(spark, views.pairs(spark, sf_dir))
    rows = readers.read_tsv_cells(spark, path)
    data = rows.filter(F.get("cells", F.lit(0)) != "Quality")
    return data.select(
        F.get("cells", F.lit(1)).cast("bigint").alias("first_id"),
        F.size("cells").alias("n_cells"),
        F.array_join("cells", "|").alias("joined"),
    )


@query
def src_tsv_quoted(spark, sf_dir):
    pairs = views.pairs(spark, sf_dir)
    awkward = F.concat("sentence", F.lit('\t"'), "lang", F.lit('"\n'), F.col("score"))
    path = views.write_twitter_file(spark, pairs.withColumn("sentence", awkward))
    return readers.read_tsv_quoted(spark, path)


@query
def src_tsv_quoted_parallel(spark, sf_dir):
    """The same file by records, in many tasks, whatever its size."""
    pairs = views.pairs(spark, sf_dir)
    awkward = F.concat("sentence", F.lit('\t"'), "lang", F.lit('"\n'), F.col("score"))
    path = views.write_twitter_file(spark, pairs.withColumn("sentence", awkward))
    return readers.read_tsv_quoted(spark, path, multi_line="records")


@query
def src_csv_parallel(spark, sf_dir):
    """A saved corpus with line ends in its fields, by records."""
    awkward = F.concat("sentence", F.lit('\n",'), "lang", F.lit('"'))
    path = views.write_pairs_csv(spark, views.corpus(spark, sf_dir).withColumn("sentence", awkward))
    return readers.read_csv_pairs(spark, path, renumber=True, multi_line="records")


@query
def src_csv_pairs(spark, sf_dir):
    path = views.write_pairs_csv(spark, views.corpus(spark, sf_dir))
    return readers.read_csv_pairs(spark, path)


@query
def src_csv_renumbered(spark, sf_dir):
    path = views.write_pairs_csv(spark, views.corpus(spark, sf_dir))
    return readers.read_csv_pairs(spark, path, renumber=True)


@query
def read_split(spark, sf_dir):
    path = fresh_path(spark, "splits")
    writers.write_splits(sampling.split_two(views.corpus(spark, sf_dir)), path)
    return readers.read_split(spark, path, "dev")


@query
def read_split_csv(spark, sf_dir):
    path = fresh_path(spark, "splits")
    writers.write_splits(sampling.split_two(views.corpus(spark, sf_dir).select(*PAIR)), path, fmt="csv")
    rows = readers.read_split(spark, path, "dev", examples=False, fmt="csv")
    return rows.select("IDS", F.nullif("sentence", F.lit("")).alias("sentence"), "paraphrase", "quality")


@query
def src_tsv_cells_quoted(spark, sf_dir):
    path = views.write_twitter_file(spark, views.pairs(spark, sf_dir))
    rows = readers.read_tsv_cells(spark, path, quote='"', columns=4)
    return rows.select("IDS", F.size("cells").alias("n_cells"), F.array_join("cells", "|", "").alias("joined"))


@query
def prepare_tpc_downsampled(spark, sf_dir):
    sources = _two_files(spark, sf_dir, views.write_twitter_file)
    return _stored(spark, "tpc", "baseline", sources, downsample=True)


@query
def row_index(spark, sf_dir):
    pairs = views.pairs(spark, sf_dir).select(F.col("IDS").alias("pair"), "sentence")
    return keys.row_index(pairs, "pair").select("IDS", "pair", "sentence")


# Normalisers, filters, row-wise functions --------------------------------


@query
def norm_mrpc(spark, sf_dir):
    raw = views.corpus(spark, sf_dir).withColumnsRenamed(
        {"sentence": "#1 String", "paraphrase": "#2 String", "quality": "Quality"}
    )
    return normalize.normalize_mrpc(raw)


def _raw_twitter(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(
        "IDS",
        F.col("sentence").alias("c0"),
        F.col("paraphrase").alias("c1"),
        F.format_string("(%d, 6)", "score").alias("c2"),
        *more,
    )


def _raw_quora(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.col("IDS").alias("id"),
        F.col("sentence").alias("question1"),
        F.col("paraphrase").alias("question2"),
        F.col("quality").alias("is_duplicate"),
    )


@query
def norm_tpc(spark, sf_dir):
    return normalize.normalize_twitter(_raw_twitter(views.pairs(spark, sf_dir)))


@query
def norm_quora(spark, sf_dir):
    return normalize.rename_quora(_raw_quora(views.pairs(spark, sf_dir)))


@query
def norm_quora_text(spark, sf_dir):
    return normalize.normalize_quora(_raw_quora(views.pairs(spark, sf_dir)))


@query
def unescape_html(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.unescape_html(F.col("html")).alias("html"))


@query
def filter_langs(spark, sf_dir):
    return normalize.filter_languages(views.corpus(spark, sf_dir), ["en", "es"])


@query
def examples_view(spark, sf_dir):
    return normalize.as_examples(views.corpus(spark, sf_dir))


@query
def label_check(spark, sf_dir):
    return normalize.label_counts(views.pairs(spark, sf_dir), "score")


# Duplicates, samples, splits ---------------------------------------------


@query
def dedup_aug(spark, sf_dir):
    return remove_duplicates(views.corpus(spark, sf_dir))


@query
def dedup_by_source(spark, sf_dir):
    return remove_duplicates(views.corpus(spark, sf_dir), by="index")


@query
def balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(views.corpus(spark, sf_dir)).select(*PAIR)


@query
def downsample_siblings(spark, sf_dir):
    return sampling.downsample_with_siblings(views.corpus(spark, sf_dir))


@query
def downsample_siblings_joined(spark, sf_dir):
    """The same by the salted join that a sample beyond the broadcast limit takes."""
    return sampling.downsample_with_siblings(views.corpus(spark, sf_dir), broadcast_keys=0)


@query
def split_two(spark, sf_dir):
    return sampling.split_two(views.corpus(spark, sf_dir)).select("IDS", "split")


@query
def split_by_source(spark, sf_dir):
    split = sampling.split_two(views.corpus(spark, sf_dir), group_by="index")
    return split.select("IDS", "split")


@query
def split_three(spark, sf_dir):
    return sampling.split_three(views.corpus(spark, sf_dir)).select("IDS", "split")


@query
def split_sizes(spark, sf_dir):
    """The corpus from raw rows to splits: languages, duplicates, split, sizes."""
    kept = normalize.filter_languages(views.corpus(spark, sf_dir), ["en", "es"])
    clean = write_table(remove_duplicates(kept), "clean")
    return sampling.split_sizes(sampling.split_two(clean))


# Augmentation ------------------------------------------------------------


@query
def augment_fanout(spark, sf_dir):
    return augment.augment_by_column(views.english(spark, sf_dir), views.rule_translation)


@query
def augment_restart(spark, sf_dir):
    english = write_table(views.english(spark, sf_dir), "english")
    path = fresh_path(spark, "augmented")
    store_augmented(english, path, TARGET_LANGUAGES[:3], column=views.rule_translation)
    return store_augmented(english, path, column=views.rule_translation)


def _partial_memory(spark, sf_dir) -> DataFrame:
    """The memory with a second, greater translation of every text, and without Yoruba."""
    memory = views.memory(spark, sf_dir).filter(F.col("src") != "yo")
    both = F.array("tgt_text", F.concat("tgt_text", F.lit("~")))
    return memory.withColumn("tgt_text", F.explode(both))


@query
def augment_job_memory(spark, sf_dir):
    english = write_table(views.english(spark, sf_dir), "english")
    path = fresh_path(spark, "augmented")
    return store_augmented(english, path, memory=_partial_memory(spark, sf_dir))


@query
def augment_job_service(spark, sf_dir):
    english = write_table(views.english(spark, sf_dir), "english")
    path = fresh_path(spark, "augmented")
    return store_augmented(english, path, ["es", "yo"], service=_rule_service)


@query
def augment_job_answers(spark, sf_dir):
    """A service with a store of answers: first for nine tenths of the rows, then for all."""
    english = write_table(views.english(spark, sf_dir), "english")
    store, path = fresh_path(spark, "answers"), fresh_path(spark, "augmented")
    some = english.filter(F.col("IDS") % 10 != 0)
    store_augmented(some, fresh_path(spark, "augmented"), ["es", "yo"], service=_rule_service, answers=store)
    return store_augmented(english, path, ["es", "yo"], service=_rule_service, answers=store)


@query
def answers_reused(spark, sf_dir):
    """How many questions the first and the second of these jobs asked; the store is compacted between them."""
    english = write_table(views.english(spark, sf_dir), "english")
    store = AnswerStore(spark, fresh_path(spark, "answers"))
    asked = None
    for run, rows in enumerate((english.filter(F.col("IDS") % 10 != 0), english)):
        store_augmented(rows, fresh_path(spark, "augmented"), ["es", "yo"], service=_rule_service, answers=store.path)
        base, versions = store._parts()
        new = store.answers().filter(F.col("version") > base).groupBy("lang", "to_foreign").count()
        new = write_table(new.withColumn("run", F.lit(run + 1)), "asked")
        asked = new if asked is None else asked.unionByName(new)
        store.compact()
    return asked.select("run", "lang", "to_foreign", F.col("count").alias("n_asked"))


@query
def augment_untranslated(spark, sf_dir):
    english = write_table(views.english(spark, sf_dir), "english")
    path = fresh_path(spark, "augmented")
    store_augmented(english, path, memory=_partial_memory(spark, sf_dir))
    return untranslated_rows(spark, path)


@query
def backtranslate_tm(spark, sf_dir):
    english = write_table(views.english(spark, sf_dir), "english")
    return augment.augment_by_memory(english, views.memory(spark, sf_dir))


@query
def untranslated(spark, sf_dir):
    """A memory without the texts of one language, and what it cannot translate."""
    english = write_table(views.english(spark, sf_dir), "english")
    memory = views.memory(spark, sf_dir).filter(F.col("src") != "yo")
    trips = augment.round_trips(memory)
    return augment.untranslated(augment.back_translate(english, trips))


def _rule_service(texts: list[str], lang: str, to_foreign: bool) -> list[str]:
    if to_foreign:
        return [f"{lang}:{t}" for t in texts]
    return [t.split(":", 1)[1] if lang in ("es", "ja") else t.split(":", 1)[1].lower() for t in texts]


@query
def augment_batches(spark, sf_dir):
    english = write_table(views.english(spark, sf_dir), "english")
    return augment.augment_by_batches(english, _rule_service)


@query
def batch_texts(spark, sf_dir):
    made = batches.batch_texts(views.turns(spark, sf_dir), "text", "conv_id", "turn")
    return made.select(
        "batch_id", F.size("texts").alias("n_texts"), F.array_join("texts", "|").alias("joined")
    )


@query
def flatten_batches(spark, sf_dir):
    made = batches.batch_texts(views.turns(spark, sf_dir), "text", "conv_id", "turn")
    return batches.flatten_batches(made).select("batch_id", "pos", "text")


# Runs, predictions and metrics -------------------------------------------


@query
def lang_sets(spark, sf_dir):
    per_lang = views.pairs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    expanded = grid.expand_to_sets(per_lang, grid.language_set_table(spark))
    return expanded.select("lang_set", "lang", "n")


@query
def run_grid(spark, sf_dir):
    sets = grid.language_set_table(spark)
    return grid.grid_sizes(views.pairs(spark, sf_dir), grid.run_grid(spark), sets)


@query
def family_rollup(spark, sf_dir):
    return grid.family_rollup(views.pairs(spark, sf_dir), grid.family_table(spark))


@query
def align_preds(spark, sf_dir):
    return metrics.unmatched(views.rule_predictions(spark, sf_dir), views.gold(spark, sf_dir), by=("model",))


@query
def argmax_preds(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    size = F.col("n_chars").cast("double")
    logits = F.array(F.lit(500.0), size, F.lit(1000.0), size / 2)
    return docs.select(
        "doc_id",
        labels.argmax(logits).alias("pred"),
        labels.squeeze(F.array(size)).alias("value"),
    )


@query
def metrics_binary(spark, sf_dir):
    found = metrics.evaluate_runs(views.predictions(spark, sf_dir), "model")
    names = ["accuracy", "precision_score", "recall_score", "f1_score", "ROC-AUC"]
    return _rounded(found, "model", names=names)


@query
def metrics_macro(spark, sf_dir):
    found = metrics.evaluate_runs(views.predictions(spark, sf_dir), "model")
    return _rounded(found, "model", names=["macro_f1_score", "weighted_f1_score"])


@query
def metrics_grid(spark, sf_dir):
    found = metrics.evaluate_runs(views.predictions(spark, sf_dir), "model", "dataset", "langs")
    return _rounded(found, "model", "dataset", "langs")


@query
def metrics_report(spark, sf_dir):
    found = metrics.evaluate_runs(views.predictions(spark, sf_dir), "model", "dataset", "langs")
    rounded = found.select(
        "model", "dataset", "langs", *[F.round(F.col(f"`{m}`"), 6).alias(m) for m in METRICS]
    )
    return metrics.metric_report(rounded, "model", "dataset", "langs")


@query
def mean_of_batch_means(spark, sf_dir):
    pairs = views.pairs(spark, sf_dir).select(F.col("IDS").alias("pair"), "score")
    numbered = keys.row_index(pairs, "pair")
    found = batches.mean_of_batch_means(numbered, "score", F.floor(F.col("IDS") / 32))
    return found.withColumn("mean_of_means", F.round("mean_of_means", 6))


@query
def results_records(spark, sf_dir):
    found = metrics.evaluate_runs(views.predictions(spark, sf_dir), "model", "dataset", "langs")
    records = metrics.result_records(found)
    path = fresh_path(spark, "records")
    for model in ("bert", "xlnet", "roberta", "albert"):
        own = records.filter(F.col("config.model") == model)
        writers.append_records(own, path)
        if model == "bert":  # its second run fails in the middle
            try:
                writers.append_records(own.withColumn("results", F.raise_error(F.lit("interrupted"))), path)
            except Exception as e:
                if "interrupted" not in str(e):
                    raise
        writers.append_records(own, path)
    stored = writers.read_records(spark, path, records.schema)
    return _rounded(stored.select("config.*", "results.*"), "model", "dataset", "langs")


@query
def report_file(spark, sf_dir):
    """The report of all runs as a text file, written twice, and its lines read back in order."""
    report = metrics_report(spark, sf_dir)
    path = fresh_path(spark, "report") + ".txt"
    for rows in (report.limit(3), report):
        writers.write_report(rows, path, "model", "dataset", "langs", "key", line="table_line")
    return keys.file_row_index(spark.read.text(path), name="place").select("place", F.col("value").alias("line"))


@query
def family_metrics(spark, sf_dir):
    counts = metrics.confusion(views.predictions(spark, sf_dir).withColumnRenamed("langs", "lang"), "model", "lang")
    found = grid.family_metrics(counts, grid.family_table(spark), "model")
    return _rounded(found, "model", "family", "branch", "language", "level")


def _set_results(spark, sf_dir) -> DataFrame:
    """Metrics per model for English alone (the baseline), English with L, and all."""
    counts = metrics.confusion(views.predictions(spark, sf_dir), "model", "dataset", "langs")
    members = {"baseline": ["en"], "all": ["en", "de", "es", "fr"]}
    members.update({code: ["en", code] for code in ("de", "es", "fr")})
    rows = [(name, code) for name, codes in members.items() for code in codes]
    sets = spark.createDataFrame(rows, "lang_set string, lang string")
    summed = (
        grid.expand_to_sets(counts.withColumnRenamed("langs", "lang"), sets)
        .groupBy("model", "dataset", F.col("lang_set").alias("langs"))
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    )
    return metrics.with_metrics(summed)


@query
def leaderboard(spark, sf_dir):
    names = ["accuracy", "f1_score", "precision_score", "recall_score"]
    board = grid.leaderboard(_set_results(spark, sf_dir), metrics=names)
    flags = [f"{m}_up" for m in names]
    return _rounded(board, "dataset", "model", "kind", "langs", *flags, names=names)


# Features and scoring ----------------------------------------------------


@query
def vocab(spark, sf_dir):
    return features.build_vocabulary(views.corpus(spark, sf_dir))


def _encoded(spark, sf_dir, **limits) -> DataFrame:
    corpus = write_table(views.corpus(spark, sf_dir), "corpus")
    vocabulary = write_table(features.build_vocabulary(corpus), "vocabulary")
    return features.encode_pairs(corpus, vocabulary, **limits)


def _shown(encoded: DataFrame) -> DataFrame:
    def joined(name: str):
        return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)

    return encoded.select(
        "IDS", "label", "la", "lb", "n_tokens", joined("input_ids"), joined("attention_mask"), joined("token_type_ids")
    )


@query
def encode_pairs(spark, sf_dir):
    return _shown(_encoded(spark, sf_dir))


@query
def encode_pairs_large_vocab(spark, sf_dir):
    """The same by the way that a vocabulary beyond the broadcast limit takes."""
    return _shown(_encoded(spark, sf_dir, broadcast_bytes=0, head=200))


@query
def cached_features(spark, sf_dir):
    folder = fresh_path(spark, "cache")

    def ask() -> DataFrame:
        return writers.cached_features(
            spark, folder, "train", "bert", 128, lambda: _encoded(spark, sf_dir)
        )

    ask()
    return _shown(ask())


def _longer() -> Callable[[pd.DataFrame], list[list[float]]]:
    """A rule in place of a model: is the paraphrase longer than the sentence?"""

    def model(chunk: pd.DataFrame) -> list[list[float]]:
        size = chunk.fillna("").map(len)
        return size[["sentence", "paraphrase"]].to_numpy().tolist()

    return model


@query
def score_pairs(spark, sf_dir):
    scored = scoring.with_predictions(scoring.score_pairs(views.corpus(spark, sf_dir), _longer))
    return scored.select(
        "IDS", "quality", F.get("logits", F.lit(0)).alias("logit0"), F.get("logits", F.lit(1)).alias("logit1"), "pred"
    )


def _stored_rule(path: str) -> Callable[[pd.DataFrame], list[list[float]]]:
    """The rule with its two factors from a file of weights."""
    with open(path, encoding="utf-8") as f:
        first, second = (float(x) for x in f.read().split())

    def model(chunk: pd.DataFrame) -> list[list[float]]:
        size = chunk.fillna("").map(len)
        return (size[["sentence", "paraphrase"]] * [first, second]).to_numpy().tolist()

    return model


@query
def score_pairs_cached(spark, sf_dir):
    """Scored in 50 tasks by a model that each worker loads once from a file of weights."""
    folder = fresh_path(spark, "weights")
    spark.createDataFrame([("1.0 0.5",)], "value string").coalesce(1).write.text(folder)
    path = spark.read.text(folder).select("_metadata.file_path").first()[0]
    rows = views.corpus(spark, sf_dir).repartition(50)
    scored = scoring.with_predictions(scoring.score_pairs(rows, _stored_rule, version=path, weights=path))
    return scored.select(
        "IDS", "quality", F.get("logits", F.lit(0)).alias("logit0"), F.get("logits", F.lit(1)).alias("logit1"), "pred"
    )


@query
def eval_split(spark, sf_dir):
    split = sampling.split_two(views.corpus(spark, sf_dir))
    return _rounded(scoring.evaluate_split(split, "dev", _longer))


def _labelled(spark, sf_dir) -> DataFrame:
    """All pairs of the labelled documents, with the document's label."""
    marks = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("mark"))
    rows = views.corpus(spark, sf_dir).withColumn("doc_id", F.expr("IDS div 1000000"))
    return rows.join(marks, "doc_id").withColumn("quality", F.col("mark")).drop("mark", "doc_id")


@query
def pair_features(spark, sf_dir):
    return scoring.pair_features(_labelled(spark, sf_dir))


@query
def fit_classifier(spark, sf_dir):
    """Word log ratios of the training pairs, and the classes they give the others."""
    rows = write_table(_labelled(spark, sf_dir), "labelled")
    split = write_table(sampling.split_two(rows, group_by="index"), "labelled-split")
    ratios = write_table(scoring.fit_word_ratios(split.filter(F.col("split") == "train")), "ratios")
    found = scoring.classify_by_ratios(ratios, split.filter(F.col("split") == "dev"))
    return found.select("IDS", "quality", "score", "pred")


@query
def eval_loss(spark, sf_dir):
    """The evaluation loss of the rule in place of a model, over batches in row order."""
    pairs = views.corpus(spark, sf_dir).withColumnRenamed("IDS", "pair")
    numbered = keys.row_index(pairs, "pair")
    found = batches.evaluation_loss(scoring.score_pairs(numbered, _longer))
    return found.select(F.round("eval_loss", 6).alias("eval_loss"), "n_batches")


_FIT = {"n_features": 3, "epochs": 3, "batches": 2, "rate": 4.0, "warmup": 1}


def _fitted(spark, sf_dir) -> tuple[DataFrame, str, DataFrame]:
    rows = write_table(_labelled(spark, sf_dir), "labelled")
    train, dev = training.stored_vectors(sampling.split_two(rows, group_by="index"), "vectors")
    path = fresh_path(spark, "fit")
    return training.fit_epochs(train, dev, path, **_FIT), path, dev


@query
def fit_epochs(spark, sf_dir):
    """Loss and metrics on the held-out pairs after every epoch of an iterative fit."""
    reports, _, _ = _fitted(spark, sf_dir)
    return _rounded(reports, "step", "epoch", F.round("dev_loss", 6).alias("dev_loss"))


@query
def fit_best_state(spark, sf_dir):
    """Classes of the held-out pairs by the state that was best on them."""
    reports, path, dev = _fitted(spark, sf_dir)
    step = training.best_step(reports)
    scored = training.score_by_state(training.read_state(spark, path, step), dev)
    return scored.select("IDS", F.lit(step).alias("step"), "quality", "pred")


# Whole jobs --------------------------------------------------------------


def _stored(spark, dataset, mode, sources, langs=None, downsample=False) -> DataFrame:
    path = fresh_path(spark, f"{dataset}-{mode}")
    prepare(spark, dataset, mode, sources, path, langs, downsample)
    return spark.read.parquet(path).select("split", *PAIR)


def _two_files(spark, sf_dir, write) -> dict[str, str]:
    """English rows play the training file, all others the test file."""
    pairs = views.pairs(spark, sf_dir)
    train = write(spark, pairs.filter(F.col("lang") == "en"))
    test = write(spark, pairs.filter(F.col("lang") != "en"))
    return {"train": train, "test": test}


@query
def prepare_mrpc_baseline(spark, sf_dir):
    return _stored(spark, "mrpc", "baseline", _two_files(spark, sf_dir, views.write_mrpc_file))


@query
def prepare_tpc_baseline(spark, sf_dir):
    return _stored(spark, "tpc", "baseline", _two_files(spark, sf_dir, views.write_twitter_file))


@query
def prepare_quora_baseline(spark, sf_dir):
    path = fresh_path(spark, "raw-quora")
    _raw_quora(views.pairs(spark, sf_dir)).write.options(header=True, quoteAll=True, escape='"').csv(path)
    return _stored(spark, "quora", "baseline", {"all": path})


@query
def prepare_mrpc_augmented(spark, sf_dir):
    raw = views.corpus(spark, sf_dir).withColumnsRenamed(
        {"sentence": "#1 String", "paraphrase": "#2 String", "quality": "Quality"}
    )
    test = views.write_mrpc_file(spark, views.pairs(spark, sf_dir).filter(F.col("lang") == "fr"))
    sources = {"augmented": views.write_pairs_csv(spark, raw), "test": test}
    return _stored(spark, "mrpc", "augmented", sources, ["en", "es", "de"], downsample=True)


@query
def prepare_tpc_augmented(spark, sf_dir):
    corpus = views.corpus(spark, sf_dir)
    sources = {
        "augmented": views.write_pairs_csv(spark, corpus),
        "dev": views.write_pairs_csv(spark, corpus.filter(F.col("lang") == "de").drop("lang", "index")),
        "test": views.write_twitter_file(
            spark, views.pairs(spark, sf_dir).filter(F.col("lang") == "fr")
        ),
    }
    return _stored(spark, "tpc", "augmented", sources, ["en", "es"])


@query
def prepare_quora_augmented(spark, sf_dir):
    corpus = views.corpus(spark, sf_dir)

    def file(lang: str) -> str:
        rows = corpus.filter(F.col("lang") == lang).drop("lang", "index")
        return views.write_pairs_csv(spark, rows)

    sources = {"augmented": views.write_pairs_csv(spark, corpus), "dev": file("de"), "test": file("fr")}
    return _stored(spark, "quora", "augmented", sources, ["en", "es"])


@query
def augment_then_dedup(spark, sf_dir):
    """Augment by the memory, number the rows anew, drop the repeats it made."""
    english = write_table(views.english(spark, sf_dir), "english")
    made = augment.augment_by_memory(english, views.memory(spark, sf_dir))
    return remove_duplicates(renumber_augmented(made, TARGET_LANGUAGES))


@query
def evaluate_run(spark, sf_dir):
    """The report of each rule model over all documents, labelled or not."""
    preds = write_table(views.rule_predictions(spark, sf_dir), "predictions")
    gold = views.gold(spark, sf_dir).withColumnRenamed("gold", "quality")
    whole = None
    for model, _ in views.CUTS:
        config = {"dataset": "docs", "model": model, "langs": "all"}
        own = preds.filter(F.col("model") == model).select("IDS", "pred")
        report = evaluate(own, gold, config, fresh_path(spark, "records"), unmatched="count")
        whole = report if whole is None else whole.unionByName(report)
    return whole.select("model", "key", F.round("value", 6).alias("value"), "table_line")


def _stored_pairs(spark, sf_dir) -> DataFrame:
    """The pairs, cut from their documents once for all sources of an experiment."""
    return write_table(views.pairs(spark, sf_dir), "pairs")


def _english(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("lang") == "en").select(*PAIR)


def _twitter_with_languages(pairs: DataFrame) -> DataFrame:
    """The Twitter rows with the languages of their keys; rows move only where keys repeat or are missing."""
    n, keys = pairs.agg(F.count(F.lit(1)), F.count_distinct("IDS")).first()
    if n == keys:
        return _raw_twitter(pairs, "lang")
    return write_table(_raw_twitter(pairs).join(pairs.select("IDS", "lang"), "IDS"), "raw")


def _grid_sources(spark, sf_dir, datasets: tuple[str, ...] = ("mrpc", "tpc", "quora")) -> dict[str, dict]:
    """Sources of the datasets: all pairs, and the English ones with their translations."""
    pairs = _stored_pairs(spark, sf_dir)
    augmented = augment_numbered(_english(pairs), views.rule_translation)
    corpus = pairs.select(*PAIR, "lang", "index")
    plain = corpus.drop("lang", "index")
    tests = corpus.filter(F.col("lang") == "fr").drop("lang", "index")
    raw = None
    if "tpc" in datasets:
        raw = _twitter_with_languages(pairs)
    of = lambda rows, french: rows.filter((F.col("lang") == "fr") == french).drop("lang", "index")
    found = {
        "mrpc": lambda: {
            "train": of(corpus, False),
            "test": tests,
            "augmented": augmented.withColumnsRenamed(
                {"sentence": "#1 String", "paraphrase": "#2 String", "quality": "Quality"}
            ),
        },
        "tpc": lambda: {"train": of(raw, False), "test": of(raw, True), "augmented": augmented, "dev": plain},
        "quora": lambda: {"all": _raw_quora(pairs), "augmented": augmented, "dev": plain, "test": tests},
    }
    return {dataset: found[dataset]() for dataset in datasets}


@query
def experiment_grid(spark, sf_dir):
    """All 3 datasets, 4 rule models and 11 language sets, and the baselines, in one go.

    A model asks if a pair is so many times as long as the average training pair of its set.
    """
    size = F.length("sentence") + F.coalesce(F.length("paraphrase"), F.lit(0))

    def fit_with(share: int):
        def fit(train: DataFrame):
            sums = write_table(
                train.groupBy("lang_set").agg(F.sum(size).alias("total"), F.count(F.lit(1)).alias("n")), "means"
            )
            return lambda test: test.join(F.broadcast(sums), "lang_set").withColumn(
                "pred", F.when(size * F.col("n") >= F.col("total") * share, 1).otherwise(0)
            )

        return fit

    models = {"bert": fit_with(1), "xlnet": fit_with(2), "roberta": fit_with(3), "albert": fit_with(4)}
    results, _ = run_whole_grid(spark, _grid_sources(spark, sf_dir), models, downsample=("mrpc",))
    return _rounded(results, "dataset", "model", "langs")


@query
def grid_members(spark, sf_dir):
    """Rows and positives of every split of every set of the sampled corpus, each split a table of its own."""
    table = prepare_grid(spark, "mrpc", _grid_sources(spark, sf_dir, ("mrpc",))["mrpc"], downsample=True)
    parts = [of_split(table, s).withColumn("split", F.lit(s)) for s in ("train", "dev", "test")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("lang_set", "split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("quality").cast("bigint")).alias("n_positive"),
        F.sum("IDS").alias("sum_ids"),
    )


@query
def experiment_runs(spark, sf_dir):
    """Rule models: is a pair as long as the average training pair, or twice that?

    Two datasets, prepared anew for the baseline and each language set. The translations
    of two languages repeat the English pairs and those of the others each other, so what
    is a duplicate depends on the set.
    """
    pairs = _stored_pairs(spark, sf_dir)
    augmented = augment_numbered(_english(pairs), views.rule_translation)
    corpus = pairs.select(*PAIR, "lang", "index")
    plain = corpus.drop("lang", "index")
    tests = corpus.filter(F.col("lang") == "fr").drop("lang", "index")
    raw = _twitter_with_languages(pairs)
    sources = {
        "tpc": {
            "train": raw.filter(F.col("lang") != "fr").drop("lang"),
            "test": raw.filter(F.col("lang") == "fr").drop("lang"),
            "augmented": augmented,
            "dev": plain,
        },
        "quora": {"all": _raw_quora(pairs), "augmented": augmented, "dev": plain, "test": tests},
    }
    size = F.length("sentence") + F.coalesce(F.length("paraphrase"), F.lit(0))

    def fit_with(share: int):
        def fit(train: DataFrame):
            mean = train.agg((F.sum(size) * share / F.count(F.lit(1))).alias("cut"))

            def predict(test: DataFrame) -> DataFrame:
                cut = mean.first()["cut"]
                return test.withColumn("pred", F.when(size >= F.lit(cut), 1).otherwise(0))

            return predict

        return fit

    models = {"bert": fit_with(1), "albert": fit_with(2)}
    corpora = {name: prepared(spark, name, own) for name, own in sources.items()}
    results, _ = experiment(corpora, models, ["es", "ko", "yo", "all"], fresh_path(spark, "records"))
    return _rounded(results, "dataset", "model", "langs")
