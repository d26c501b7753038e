"""Text functions: columns in, columns out."""

from __future__ import annotations

import html
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.constants import NA_WORDS

# Fixed value: what Python's str.strip removes, as a Java character class.
_SPACE = r"[\s\x1c-\x1f]"
# Fixed value: the blanks that separate words.
WORD_GAP = r"[ \t\n\f\r]+"


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    left = F.regexp_replace(text, rf"(?U)^{_SPACE}+", "")
    return F.regexp_replace(left, rf"(?U){_SPACE}+$", "")


def tab_field(cells: Column, k: int) -> Column:
    """Field ``k`` of a split line, null when the line is shorter."""
    return F.get(cells, F.lit(k))


def null_words(text: Column) -> Column:
    """Null for the cell texts that CSV files use for a missing value."""
    return F.when(~text.isin(NA_WORDS), text)


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([t and normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return pa.array([t and html.unescape(t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Pure ASCII never changes, so it is not sent to Python."""
    odd = text.rlike(r"[^\x00-\x7f]")
    return F.coalesce(_nfkc(F.when(odd, text)), text)


def unescape_html(text: Column) -> Column:
    """HTML entities to characters. Text without ``&`` stays in the JVM."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def quora_text(text: Column) -> Column:
    """Null to ``nan``, plain quotes out, NFKC, then quotes around the whole."""
    plain = F.replace(F.coalesce(text.cast("string"), F.lit("nan")), F.lit('"'), F.lit(""))
    return F.concat(F.lit('"'), nfkc(plain), F.lit('"'))


def words(text: Column) -> Column:
    """Lower-cased words; no words for a null text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP, -1)
    return F.array_remove(parts, "")
