from __future__ import annotations

import html
import unicodedata

from pyspark.sql import functions as F

from pairloom.functions import labels, text


def column(spark, values, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_strip_is_pythons(spark):
    values = ["  a b ", " x ", "\x1ca\x1f", "\t\n", "", "\u0085y　", None]
    want = [v.strip() if v is not None else None for v in values]
    assert column(spark, values, text.strip) == want


def test_nfkc_and_unescape_are_pythons(spark):
    values = ["plain", "＂ﬁ", "é", "a &amp; b &lt;&#233;&hearts;", "&&notit;", "", None]
    nfkc = [v if v is None else unicodedata.normalize("NFKC", v) for v in values]
    assert column(spark, values, text.nfkc) == nfkc
    assert column(spark, values, text.unescape_html) == [v if v is None else html.unescape(v) for v in values]


def test_nfkc_of_all_assigned_characters(spark):
    chars = [chr(i) for i in range(0x30000) if unicodedata.category(chr(i)) not in ("Cs", "Cn", "Co")]
    values = ["a" + "".join(chars[i : i + 64]) for i in range(0, len(chars), 64)]
    assert column(spark, values, text.nfkc) == [unicodedata.normalize("NFKC", v) for v in values]


def test_quora_text(spark):
    # Plain quotes go first, then full-width ones become plain.
    values = ['"a" ＂b＂', None, "x"]
    assert column(spark, values, text.quora_text) == ['"a "b""', '"nan"', '"x"']


def test_null_words(spark):
    values = ["NA", "null", "", "nan ", "None", "n/a", None]
    assert column(spark, values, text.null_words) == [None, None, None, "nan ", "None", None, None]


def test_words(spark):
    assert column(spark, [" A b\tA\n", "", None], text.words) == [["a", "b", "a"], [], []]


def test_scores(spark):
    values = ["(3, 6)", "(4, 6)", "(2, 6)", "(x, 6)"]
    assert column(spark, values, lambda c: labels.score_of(c, strict=False)) == [3, 4, 2, None]


def test_argmax_takes_the_first_of_ties(spark):
    df = spark.createDataFrame(
        [([0.5, 0.5],), ([1.0, 2.0, 2.0],), ([3.0, float("nan"), float("nan")],)], "x array<double>"
    )
    assert [r[0] for r in df.select(labels.argmax(F.col("x"))).collect()] == [0, 1, 1]
