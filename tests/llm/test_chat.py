from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from pairloom.llm.chat import CHUNK, format_chats, read_loss, read_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, spans int"


def expected(rows):
    """Formatted texts by plain Python."""
    import re

    control = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)")
    esc = lambda s: control.sub(r"\1\\\2\3", s)
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        text, last = "", None
        for role, body in turns:
            if role == last:
                text += "<|same|>" + esc(body)
            else:
                text += ("" if last is None else "<|end|>") + f"<|turn|>{esc(role)}<|text|>{esc(body)}"
            last = role
        out[conv] = (turns, text + "<|end|>")
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    chats = format_chats(df)
    got = chats.select(
        "*",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_from"), F.col("loss_bytes")).alias("loss"),
    ).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        turns, text = want[r.conv_id]
        assert r.formatted == text
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == [t for role, t in turns if role == "assistant"]


def test_round_trip(spark):
    nasty = [
        None, "", "<|", "<|end|>", "<\\|end|>", "<\\\\|", "</s>[INST] ok [/INST]", "[\\INST]", "a\nb\r", "<<|turn|>", "|>", "<",
        "é<|same|>ß", "<s></s>", "<<SYS>>", "$1\\$2", "x" * 5000, "日本<|text|>", "[[INST]]", "<|text|>user",
    ]
    rng = random.Random(3)
    roles = ["user", "assistant", "assistant", "system", None, "<|text|>", "tool\n"]
    rows = [(c, t, rng.choice(roles), rng.choice(nasty)) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (100, None, "assistant", "first"), (100, 0, "user", "x")]
    rows += [(101, 5, "user", "same"), (101, 5, "user", "same"), (101, 5, "assistant", "same"), (101, -3, "user", "neg")]
    check(spark, rows)


def test_long_conversation_over_chunks(spark):
    rows = [(1, t, "assistant" if t % 5 < 3 else "user", f"{t}<|") for t in range(3 * CHUNK + 7)]
    check(spark, rows + [(2, CHUNK * 10, "assistant", "far"), (2, 0, "assistant", "near")])


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_a_very_long_conversation(spark):
    n = 100_000
    turns = spark.range(n).select(
        F.lit(1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("é "), F.col("id").cast("string")).alias("text"),
    )
    chats = format_chats(turns.repartition(8))
    row = chats.select(
        F.size("loss_from").alias("n"), F.sha2(F.array_join(read_loss(F.col("formatted"), F.col("loss_from"), F.col("loss_bytes")), ""), 256).alias("loss")
    ).first()
    assert row.n == n // 2
    assert row.loss == hashlib.sha256("".join(f"é {i}" for i in range(1, n, 2)).encode()).hexdigest()
