"""Explicit schemas of every layout the readers accept, and a column check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}


def struct(**columns: str) -> T.StructType:
    """A schema from names and type names; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


_PAIR = {"IDS": "bigint", "sentence": "string", "paraphrase": "string", "quality": "int"}
PAIRS = struct(**_PAIR)
AUGMENTED = struct(**_PAIR, lang="string", index="bigint")
RAW_TWITTER = struct(c0="string", c1="string", c2="string", c3="string")
RAW_QUORA = struct(id="bigint", question1="string", question2="string", is_duplicate="int")
RAW_MRPC_AUGMENTED = struct(
    **{"IDS": "bigint", "#1 String": "string", "#2 String": "string"},
    Quality="int",
    lang="string",
    index="bigint",
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise on the driver, before any job, when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the input has {df.columns}")
    return df
