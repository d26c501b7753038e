"""Chat formatting with Spark expressions only.

Turns are sorted as structs inside array aggregates, adjacent turns of one role are
merged into one block, and blocks are concatenated. A template mark never occurs inside
a text: every control string in it gets one backslash after its bracket, one more if it
already has some, so that taking one away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, JOIN, CLOSE = "<|turn|>", "<|text|>", "<|same|>", "<|end|>"
#: Control strings of this and of common other templates; the bracket comes first.
CONTROL = r"(\||/?s>|/?INST\]|/?SYS>)"
CHUNK = 256  # turn numbers that are collected together first


def escape(text: Column) -> Column:
    """Put one backslash into every control string."""
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", r"$1$2$3")


def format_chats(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """One row per conversation: conversation, formatted, loss_from, loss_bytes.

    ``formatted`` is, for every run of turns with one role,
    ``<|turn|>role<|text|>text<|same|>text...<|end|>``. ``loss_from`` and ``loss_bytes``
    are the places (0-based, in UTF-8 bytes) and lengths of the escaped texts of role
    ``learn``, which are the loss mask.

    Turns go by ``turn``; equal turn numbers by role, then text, so ties and repeated
    rows have one order and all stay. A null turn number comes first, a null text or role
    is empty, null conversation ids are one conversation. Other columns are not read. No
    rows give no conversations.

    Turns are collected for CHUNK turn numbers at a time, and the chunks' strings then
    joined, so that the turns of one very long conversation are sorted and escaped in
    many tasks; only its one output string comes together.
    """
    rows = turns.select(
        F.col(f"`{conversation}`").alias("_c"),
        F.floor(F.col(f"`{turn}`") / CHUNK).alias("_part"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    # A chunk: its first and last role, its text from the first text to the last, made of
    # segments (text, whether learned) that alternate between marks and texts, and the
    # learned segments' places in it. Places are added up within chunks, then over chunks,
    # so that a long conversation costs no square of its turns.
    at = F.col("turns")
    chunks = rows.groupBy("_c", "_part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segments = F.flatten(
        F.transform(
            at,
            lambda t, i: F.array(
                F.struct(
                    F.when(i == 0, F.lit(""))
                    .when(t["role"] == F.get(at["role"], i - 1), F.lit(JOIN))
                    .otherwise(F.concat(F.lit(CLOSE + OPEN), escape(t["role"]), F.lit(HEAD)))
                    .alias("s"),
                    F.lit(False).alias("learn"),
                ),
                F.struct(escape(t["text"]).alias("s"), (t["role"] == learn).alias("learn")),
            ),
        )
    )
    chunks = chunks.select(
        "_c",
        F.struct(
            "_part",
            at["role"][0].alias("first"),
            F.element_at(at["role"], -1).alias("last"),
            segments.alias("segments"),
        ).alias("chunk"),
    ).withColumn("sizes", F.transform("chunk.segments", lambda x: F.octet_length(x["s"]).cast("bigint")))
    places = F.zip_with(
        _starts(F.col("sizes")),
        "chunk.segments",
        lambda at, x: F.struct(at.alias("at"), F.octet_length(x["s"]).cast("bigint").alias("bytes"), x["learn"].alias("learn")),
    )
    chunks = chunks.select(
        "_c",
        F.struct(
            F.col("chunk._part").alias("part"),
            F.col("chunk.first").alias("first"),
            F.col("chunk.last").alias("last"),
            F.array_join(F.col("chunk.segments.s"), "").alias("body"),
            F.filter(places, lambda p: p["learn"]).alias("spans"),
        ).alias("chunk"),
    )
    whole = chunks.groupBy("_c").agg(F.sort_array(F.collect_list("chunk")).alias("chunks"))
    all_ = F.col("chunks")
    heads = F.transform(
        all_,
        lambda c, i: F.when(
            i == 0, F.concat(F.lit(OPEN), escape(c["first"]), F.lit(HEAD))
        )
        .when(c["first"] == F.get(all_["last"], i - 1), F.lit(JOIN))
        .otherwise(F.concat(F.lit(CLOSE + OPEN), escape(c["first"]), F.lit(HEAD))),
    )
    whole = whole.withColumn("heads", heads)
    length = lambda c: F.octet_length(c).cast("bigint")
    bases = _starts(F.zip_with("heads", "chunks", lambda h, c: length(h) + length(c["body"])))
    bases = F.zip_with(F.slice(bases, F.lit(1), F.size("chunks")), "heads", lambda at, h: at + length(h))
    whole = whole.withColumn("bases", bases)
    spans = F.flatten(
        F.zip_with(
            "bases",
            "chunks",
            lambda base, c: F.transform(c["spans"], lambda p: F.struct((base + p["at"]).alias("at"), p["bytes"].alias("bytes"))),
        )
    )
    whole = whole.select(
        F.col("_c").alias(conversation),
        F.concat(
            F.array_join(F.zip_with("heads", "chunks", lambda h, c: F.concat(h, c["body"])), ""), F.lit(CLOSE)
        ).alias("formatted"),
        spans.alias("spans"),
    )
    return whole.select(
        conversation,
        "formatted",
        F.col("spans.at").alias("loss_from"),
        F.col("spans.bytes").alias("loss_bytes"),
    )


def _starts(sizes: Column) -> Column:
    """Sums of the sizes before each, and of all: one element more than ``sizes``."""
    return F.aggregate(
        sizes,
        F.array(F.lit(0).cast("bigint")),
        lambda found, x: F.array_append(found, F.element_at(found, -1) + x),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted text holds."""
    inner = F.substring(formatted, F.lit(len(OPEN) + 1), F.char_length(formatted) - len(OPEN + CLOSE))
    mark = lambda m: "\\Q" + m + "\\E"
    blocks = F.transform(F.split(inner, mark(CLOSE + OPEN), -1), lambda b: F.split(b, mark(HEAD), 2))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.get(b, F.lit(1)), mark(JOIN), -1),
                lambda t: F.struct(unescape(F.get(b, F.lit(0))).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, loss_from: Column, loss_bytes: Column) -> Column:
    """array<string>: the texts under the loss mask, unescaped.

    The text is cut for CHUNK spans at a time, and spans are cut from these cuts.
    """
    first = F.sequence(F.lit(1), F.greatest(F.size(loss_from), F.lit(1)), F.lit(CHUNK))
    blocks = F.transform(
        first,
        lambda i: F.struct(
            F.slice(loss_from, i, F.lit(CHUNK)).alias("at"),
            F.slice(loss_bytes, i, F.lit(CHUNK)).alias("bytes"),
        ),
    )
    cut = lambda data, at, n: F.substring(data, (at + 1).cast("int"), n.cast("int"))
    last = lambda b: F.element_at(b["at"], -1) + F.element_at(b["bytes"], -1)
    pieces = F.transform(
        F.filter(blocks, lambda b: F.size(b["at"]) > 0),
        lambda b: F.struct(
            cut(formatted.cast("binary"), b["at"][0], last(b) - b["at"][0]).alias("data"), b["at"].alias("at"), b["bytes"].alias("bytes")
        ),
    )
    texts = F.transform(
        pieces,
        lambda p: F.zip_with(
            p["at"], p["bytes"], lambda at, n: unescape(cut(p["data"], at - p["at"][0], n).cast("string"))
        ),
    )
    return F.flatten(texts)
