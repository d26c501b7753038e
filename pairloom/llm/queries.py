"""The operators of this folder as queries over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.alignment import align_tokens
from pairloom.llm.chat import format_chats, read_loss, read_turns
from pairloom.llm.decontaminate import find_leaks
from pairloom.llm.language_model import score
from pairloom.llm.nearest import Index
from pairloom.llm.packing import pack
from pairloom.llm.quality import fit_quality, grade
from pairloom.llm.repeats import find_runs
from pairloom.llm.sharding import assign_shards
from pairloom.llm.similarity import similar_documents
from pairloom.llm.token_counts import Ledger
from pairloom.llm.toxicity import fit_toxicity, score_toxicity
from pairloom.llm.url_filter import filter_urls, host_of, parents, url_key
from pairloom.shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, read back from its formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    chats = format_chats(turns.unionByName(tricky))
    read = chats.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss_from"), F.col("loss_bytes")), "").alias("loss"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _hex(digest: Column, first: int, n: int) -> Column:
    return F.conv(F.substring(digest, first, n), 16, 10).cast("bigint")


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries made from the pages' own hosts and URLs; the tables hold no lists.

    Digits of a key's md5 say whether it is listed, when, and when it is taken off and
    put back. Hosts and the hosts above them are on ``spam``, URLs on ``malware``.
    """
    keys = (
        pages.select(F.explode(parents(host_of(F.col("url")))).alias("key"))
        .distinct()
        .select(F.lit("spam").alias("list"), F.lit("host").alias("kind"), "key")
        .unionByName(
            pages.select(F.lit("malware").alias("list"), F.lit("url").alias("kind"), url_key(F.col("url")).alias("key"))
            .filter("key IS NOT NULL")
            .distinct()
        )
    )
    digest = F.md5("key")
    at = lambda hours: F.timestamp_seconds(F.lit(1704067200) + 3600 * hours)
    first = _hex(digest, 1, 4) % 8760
    off, back = first + 1 + _hex(digest, 5, 3), first + 1 + _hex(digest, 5, 3) + 1 + _hex(digest, 8, 3)
    entry = lambda action, hours: F.struct(F.lit(action).alias("action"), at(hours).alias("effective_at"))
    return (
        keys.filter(_hex(digest, 11, 1) < 6)
        .select(
            "list",
            "kind",
            "key",
            F.explode(
                F.when(_hex(digest, 12, 1) < 6, F.array(entry("add", first)))
                .when(_hex(digest, 12, 1) < 11, F.array(entry("add", first), entry("remove", off)))
                .otherwise(F.array(entry("add", first), entry("remove", off), entry("add", back)))
            ).alias("e"),
        )
        .select("list", "kind", "key", "e.*")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries in force when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hours = _hex(F.md5(F.col("page_id").cast("string")), 1, 5) % 17520
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + 3600 * hours))
    return filter_urls(captures, dated_entries(pages)).select(
        "page_id", "url_host", F.array_join("url_lists", ",").alias("url_lists"), "url_listed"
    )


VERSIONS = ["words-1", "words-2", "bytes-1"]


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents, the first and second sent again.

    The first inserts every document, the second revises those of several lines to all
    lines but the first, the third deletes those of fewer than 200 characters.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    change = lambda rows, op, seq: rows.withColumns({"op": F.lit(op), "seq": F.lit(seq)})
    batches = {
        "load": change(docs, "upsert", 1),
        "revise": change(docs, "upsert", 2)
        .filter(F.instr("text", "\n") > 0)
        .withColumn("text", F.expr("substring(text, instr(text, '\n') + 1)")),
        "delete": change(docs, "delete", 3).filter(F.char_length("text") < 200),
    }
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    for name in ("load", "load", "revise", "delete", "revise"):
        ledger.commit(name, batches[name], VERSIONS)
    return ledger.totals()


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return Index(vectors).nearest(vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def remainder(n: int) -> Column:
    """crc32 of the document id as text, modulo n; 0 marks rows held out."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 4-word shingles have a similarity of 0.85 or more, and each one's links."""
    classes = similar_documents(table(spark, sf_dir, "documents"), words=4, threshold=(85, 100))
    return classes.select("doc_id", "n_shingles", "component_id", "n_links")


def ratings(labels: DataFrame) -> DataFrame:
    """Three grades from the two labels: 0 bad quality, 1 good but toxic, 2 good and not toxic.

    A row whose labels do not say which has no grade.
    """
    good, toxic = F.col("quality") == 1, F.col("toxic")
    grade_ = F.when(F.col("quality") == 0, 0).when(good & (toxic == 1), 1).when(good & (toxic == 0), 2)
    return labels.select("doc_id", grade_.alias("rating"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, and selection from grade 1 on, of every document; a fifth of the ratings is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, ratings(table(spark, sf_dir, "labels")), remainder(5) != 0, label="rating")
    return grade(docs, model, keep=["doc_id"]).withColumn("held_out", remainder(5) == 0)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, remainder(10) != 0, keep=["doc_id"]).select(
        "doc_id",
        (remainder(10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of 2048."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_path()).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the labels is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return score_toxicity(docs, model, keep=["doc_id"]).select(
        "doc_id",
        (remainder(5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.col("toxic").cast("int").alias("predicted"),
        F.size("toxic_hits").alias("n_hits"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    runs = F.zip_with("hit_from", "hit_to", lambda a, b: (b - a).cast("bigint"))
    return leaks.select(
        "doc_id",
        "n_words",
        F.aggregate(runs, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_items") > 0).alias("contaminated"),
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards whose counts differ by one at most; equal texts share a place."""
    return assign_shards(table(spark, sf_dir, "documents"), 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts, by crc32 of the id, repeats a stretch from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    sized = chosen.withColumns({"n": n, "a": F.when(n > 0, F.pmod("g", n))})
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    at = sized.withColumn("p", period)
    moved = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.transform("words", lambda w, i: F.get(F.col("words"), moved(i).cast("int")))
    return at.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, a tenth of the documents made periodic."""
    found = find_runs(made_periodic(table(spark, sf_dir, "documents")), keep=["doc_id"])
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"])))
    return found.withColumn("top", first).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.l")).alias("length"),
        F.col("top.period").alias("period"),
        F.expr("(-1000 * top.l) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two tokenizers, aligned."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_url_filter": op2_url_filter,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality": op4_quality,
    "op5_nearest": op5_nearest,
    "op6_lm_score": op6_lm_score,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_sharding": op11_sharding,
    "op12_runs": op12_runs,
    "op13_alignment": op13_alignment,
}
