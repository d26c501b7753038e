"""Scans of the file layouts, all with explicit schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import schemas
from pairloom.functions.text import null_words, strip, tab_field
from pairloom.operators.keys import file_row_index
from pairloom.operators.normalize import as_examples
from pairloom.shared import write_table
from pairloom.sources.records import quoted_records

BOM = "\ufeff"
#: How quoted files are scanned: ``MultiLine`` values of the readers.
MultiLine = bool | str | None


def read_tsv_pairs(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Tab-separated lines without quoting: label, two ids, sentence, paraphrase.

    ``IDS`` is the line number after the header of each file. White space at
    both line ends goes before the split, so an empty first field shifts the
    rest. A label that is not a number fails the job; ``read_tsv_rejects``
    lists such lines.
    """
    cells = F.split(strip(F.col("value")), "\t", -1)
    lines = file_row_index(spark.read.text(path), header=header)
    return lines.select("IDS", cells.alias("cells")).select(
        "IDS",
        tab_field(F.col("cells"), 3).alias("sentence"),
        tab_field(F.col("cells"), 4).alias("paraphrase"),
        tab_field(F.col("cells"), 0).cast("int").alias("quality"),
    )


def read_tsv_checked(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """``read_tsv_pairs`` of the good lines, and the others as ``IDS, reason, line``.

    Every line is parsed and tagged once, and stored with its tag; both tables are read
    from there. A line is bad when its label is no whole number ("label") or when it has no
    fifth field ("paraphrase").
    """
    cells = F.split(strip(F.col("value")), "\t", -1)
    lines = file_row_index(spark.read.text(path), header=header)
    label, second = tab_field(F.col("cells"), 0).try_cast("int"), tab_field(F.col("cells"), 4)
    reason = F.when(label.isNull(), "label").when(second.isNull(), "paraphrase")
    parsed = lines.select("IDS", "value", cells.alias("cells")).withColumn("reason", reason)
    tagged = write_table(
        parsed.select(
            "IDS",
            "reason",
            tab_field(F.col("cells"), 3).alias("sentence"),
            second.alias("paraphrase"),
            label.alias("quality"),
            F.when(F.col("reason").isNotNull(), F.col("value")).alias("line"),
        ),
        "tagged-lines",
    )
    good = tagged.filter(F.col("reason").isNull()).select("IDS", "sentence", "paraphrase", "quality")
    return good, tagged.filter(F.col("reason").isNotNull()).select("IDS", "reason", "line")


def read_tsv_rejects(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The lines whose label is not a number or that have no paraphrase."""
    return read_tsv_checked(spark, path, header)[1].select("IDS", "line")


def read_tsv_cells(
    spark: SparkSession, path: str, quote: str | None = None, columns: int | None = None, multi_line: MultiLine = None
) -> DataFrame:
    """Rows as arrays of text cells, without byte-order mark and header rule.

    Without ``quote`` rows may differ in length. With it a field may hold tabs
    and line ends, and ``columns`` gives the widest row; missing cells at the
    end of a row, or empty ones there, are left out.
    """
    if quote is None:
        lines = file_row_index(spark.read.text(path))
        text = F.when(F.col("IDS") == 0, F.ltrim(F.col("value"), F.lit(BOM))).otherwise(F.col("value"))
        empty = F.array().cast("array<string>")
        cells = F.when(text == "", empty).otherwise(F.split(text, "\t", -1))
        return lines.select("IDS", cells.alias("cells"))
    if not columns:
        raise ValueError("a quoted scan needs the number of columns")
    names = [f"c{i}" for i in range(columns)]
    rows = _numbered(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]), quote, multi_line)
    first = F.when(F.col("IDS") == 0, F.ltrim(F.col("c0"), F.lit(BOM))).otherwise(F.col("c0"))
    filled = F.array(*[F.coalesce(c, F.lit("")) for c in [first, *map(F.col, names[1:])]])
    ends = [F.when(F.col(n).isNotNull(), i + 1).otherwise(0) for i, n in enumerate(names)]
    width = F.greatest(*ends, F.lit(0))
    return rows.select("IDS", F.slice(filled, F.lit(1), width).alias("cells"))


def read_tsv_quoted(
    spark: SparkSession,
    path: str,
    schema: T.StructType = schemas.RAW_TWITTER,
    na_words: bool = True,
    multi_line: MultiLine = None,
) -> DataFrame:
    """Headerless tab-separated rows with ``"`` quoting, plus ``IDS`` in file order.

    A field may hold line ends. ``multi_line`` says how such files are scanned: "records"
    in many tasks (``sources.records``), True in one task for each file, by Spark alone.
    By default a file that is larger than an input split is scanned in many tasks; smaller
    ones are one task each in any case. False is for files known to have no line ends in fields.
    """
    rows = _numbered(spark, path, schema, '"', multi_line)
    return _without_na(rows, schema) if na_words else rows


def _by_records(spark: SparkSession, path: str, quote: str, multi_line: MultiLine) -> bool:
    """Whether a quoted scan goes by records."""
    if multi_line not in (None, True, False, "records"):
        raise ValueError(f"multi_line={multi_line!r}")
    if multi_line == "records" and quote != '"':
        raise ValueError("a scan by records knows double quotes only")
    if multi_line is not None or quote != '"':
        return multi_line == "records"
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    return (largest or 0) > split


def _numbered(spark, path, schema, quote, multi_line) -> DataFrame:
    """``IDS`` and the fields of a headerless quoted file."""
    if not _by_records(spark, path, quote, multi_line):
        return file_row_index(_quoted(spark, path, schema, quote, multi_line is not False))
    records, _ = quoted_records(spark, path, "\t")
    return _parsed(records, schema, "\t").select("IDS", "_row.*")


def _parsed(records: DataFrame, schema: T.StructType, sep: str) -> DataFrame:
    """Records parsed by Spark into ``_row``."""
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    return records.withColumn("_row", F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options))


def _quoted(spark, path, schema, quote, multi_line=True) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("quote", quote)
        .option("escape", quote)
        .option("multiLine", multi_line)
        .csv(path)
    )


def read_csv_pairs(
    spark: SparkSession,
    path: str,
    schema: T.StructType = schemas.AUGMENTED,
    renumber: bool = False,
    na_words: bool = True,
    multi_line: MultiLine = None,
) -> DataFrame:
    """CSV with a header: columns by name, all others (a saved row index) dropped.

    Columns of the schema that the file lacks are left out. ``renumber`` sets
    ``IDS`` to the row number in file order. All files of a folder must have the
    same columns in the same order; a file that differs fails the job, unless
    the header has a blank name and Spark reads the files, because Spark cannot check that.
    ``multi_line`` as in ``read_tsv_quoted``.
    """
    by_records = _by_records(spark, path, '"', multi_line)
    reader = spark.read.options(header=True, escape='"', multiLine=multi_line is not False)
    scan = reader.csv(path)
    names = scan.columns
    if by_records:
        scan = _csv_records(spark, path, names)
    elif not any(re.fullmatch(r"_c\d+", name) for name in names):
        scan = reader.option("enforceSchema", False).csv(path)
    fields = [f for f in schema.fields if f.name in names and not (renumber and f.name == "IDS")]
    own = ["_at"] if by_records and renumber else []
    named = scan.select(*own, *[F.col(f"`{f.name}`") for f in fields])
    if renumber:
        named = named.withColumnRenamed("_at", "IDS") if by_records else file_row_index(named)
    wanted = T.StructType(fields)
    cleaned = _without_na(named, wanted) if na_words else named
    typed = [
        F.col(f"`{f.name}`").cast("decimal(38, 6)").cast(f.dataType).alias(f.name)
        if f.name == "index"  # saved as 3.0 where some rows have none
        else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
        for f in fields
    ]
    return cleaned.select(*(["IDS"] if renumber else []), *typed)


def _csv_records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The columns of CSV files with one header, and ``_at``, the row number in file order."""
    places = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
    records, headers = quoted_records(spark, path, ",", header=True)
    if _parsed(headers, places, ",").select("_row").distinct().limit(2).count() > 1:
        raise ValueError(f"the files of {path} have different headers")
    rows = _parsed(records, places, ",")
    return rows.select(F.col("IDS").alias("_at"), *[F.col("_row")[f"c{i}"].alias(n) for i, n in enumerate(names)])


def _without_na(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.withColumns({f.name: null_words(F.col(f"`{f.name}`")) for f in schema.fields})


def read_split(
    spark: SparkSession,
    path: str,
    mode: str,
    examples: bool = True,
    fmt: str = "parquet",
    schema: T.StructType = schemas.PAIRS,
) -> DataFrame:
    """One split of a stored corpus; the other splits are pruned, not read.

    ``fmt="csv"`` reads what ``write_splits`` has written so, with its columns in the
    order of ``schema``; there an empty text and a missing one are the same.
    """
    if mode not in ("train", "dev", "test"):
        raise ValueError(f"unknown split {mode!r}")
    if fmt == "csv":
        whole = T.StructType([*schema.fields, T.StructField("split", T.StringType())])
        options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "enforceSchema": False}
        stored = spark.read.schema(whole).options(**options).csv(path)
    else:
        stored = spark.read.parquet(path)
    rows = stored.filter(F.col("split") == mode).drop("split")
    return as_examples(rows) if examples else rows
