"""Token counts kept as rollups that signed deltas maintain.

The ledger is a folder of committed batches. A batch holds changes of documents: inserts,
revisions and deletions. It is turned into signed deltas against the rows that earlier
batches have left, and only deltas are added to the totals by source, language and
tokenizer version; nothing is ever counted again from the texts. A batch becomes visible
by one step, the renaming of its commit file, and a batch whose commit exists is left
alone, so that a repeated or interrupted batch counts once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Mapping
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.text import worker_cache

_DELTAS = "doc_id bigint, version string, source string, lang string, sign int, tokens bigint, batch string"
_TOTALS = "source string, lang string, version string, documents bigint, tokens bigint"
KEYS = ["source", "lang", "version"]
STATE = ["doc_id", "version", "source", "lang", "tokens"]


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a whole text by a tokenizer version; null and empty texts have none.

    ``words-1`` counts runs without ASCII white space, ``words-2`` counts them and each
    ASCII punctuation sign that ends one, ``bytes-1`` counts UTF-8 bytes.
    """
    text = F.coalesce(text, F.lit(""))
    spaces = " \t\n\x0b\x0c\r"
    flat = F.translate(text, spaces, " " * len(spaces))
    words = F.regexp_count(flat, F.lit("[^ ]+"))
    if version == "words-1":
        return words.cast("bigint")
    if version == "words-2":
        closing = F.regexp_count(flat, F.lit("[!-/:-@\\[-`{-~](?= |\\z)"))
        return (words + closing).cast("bigint")
    if version == "bytes-1":
        return F.octet_length(text).cast("bigint")
    raise ValueError(f"unknown tokenizer version {version!r}")


def tokenizer_version(path: str) -> Callable[[Column], Column]:
    """A tokenizer version for ``Ledger.commit``: ids that the tokenizer file gives for a
    whole text, special tokens neither added nor read; null and empty texts have none.

    The file is read on the driver; a worker loads it once.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    name = ("token counts", hashlib.sha256(spec.encode()).hexdigest())

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        cache = worker_cache()
        if name not in cache:
            from tokenizers import Tokenizer

            cache[name] = Tokenizer.from_str(spec)
            cache[name].encode_special_tokens = True
        found = cache[name].encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(e.ids) for e in found], dtype="int64")

    return count


class Ledger:
    """Totals in a folder that all executors and later jobs can reach.

    ``deltas/<batch>-<attempt>`` holds signed deltas by document and version,
    ``totals/<batch>-<attempt>`` their sums by source, language and version, and
    ``commits/<batch>`` names the attempt that counts. Batches are committed one after
    another; a stale attempt of a batch that has been committed meanwhile never counts.
    ``compact`` folds committed batches into one snapshot, which ``snapshots/<number>`` names
    together with the batches in it; later batches read the snapshot and what came after it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def committed(self) -> dict[str, str]:
        """Batch names and the attempts that count; one small file for each batch."""
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return {}
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return {name: self._lines(f"{self.path}/commits/{name}")[0] for name in names}

    def _sources(self) -> tuple[str | None, list[str]]:
        """The last snapshot, if any, and the committed batches, with attempts, that are not in it."""
        folder = self._path(f"{self.path}/snapshots")
        committed = self.committed()
        if not self._fs.exists(folder):
            return None, [f"{b}-{a}" for b, a in sorted(committed.items())]
        last = max((s.getPath().getName() for s in self._fs.listStatus(folder)), key=int)
        name, *inside = self._lines(f"{self.path}/snapshots/{last}")
        return name, [f"{b}-{a}" for b, a in sorted(committed.items()) if b not in set(inside)]

    def _lines(self, path: str) -> list[str]:
        java = self.spark._jvm.java.io
        reader = java.BufferedReader(java.InputStreamReader(self._fs.open(self._path(path))))
        lines = []
        while (line := reader.readLine()) is not None:
            lines.append(line)
        reader.close()
        return lines

    def _read(self, kind: str, schema: str) -> DataFrame:
        snapshot, after = self._sources()
        names = ([snapshot] if snapshot else []) + after
        paths = [f"{self.path}/{kind}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def deltas(self) -> DataFrame:
        """Signed rows of the last snapshot and all batches after it: doc_id, version, source, lang, sign, tokens, batch."""
        return self._read("deltas", _DELTAS)

    def current(self, documents: DataFrame | None = None) -> DataFrame:
        """The rows that count now, of all documents or those of ``documents`` (doc_id). An insertion and its removal cancel."""
        rows = self.deltas()
        if documents is not None:
            rows = rows.join(documents.select("doc_id"), "doc_id", "left_semi")
        left = rows.groupBy("doc_id", "version", "source", "lang", "tokens").agg(F.sum("sign").alias("n"))
        return left.filter("n > 0").select(*STATE)

    def totals(self) -> DataFrame:
        """documents and tokens by source, language and tokenizer version, from the batches' stored sums alone."""
        return (
            self._read("totals", _TOTALS)
            .groupBy(*KEYS)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .filter("documents != 0 OR tokens != 0")
        )

    def _store(self, rows: DataFrame, name: str) -> None:
        """Signed rows and their sums, which are made from the stored rows."""
        rows.select("doc_id", "version", "source", "lang", "sign", "tokens", "batch").write.parquet(f"{self.path}/deltas/{name}")
        stored = self.spark.read.schema(_DELTAS).parquet(f"{self.path}/deltas/{name}")
        sums = stored.groupBy(*KEYS).agg(
            F.sum("sign").cast("bigint").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")
        )
        sums.write.parquet(f"{self.path}/totals/{name}")

    def compact(self) -> bool:
        """Fold the last snapshot and the batches after it into a new snapshot; False if there are none.

        Totals stay the same, and batches that are in a snapshot stay committed. Not to be run
        beside a commit, which reads the folders that count before. Nothing is deleted.
        """
        snapshot, after = self._sources()
        if not after:
            return False
        inside = sorted(self.committed())
        attempt = f"snapshot-{uuid.uuid4().hex}"
        rows = self.current().withColumns({"sign": F.lit(1), "batch": F.lit(attempt)})
        self._store(rows, attempt)
        folder = self._path(f"{self.path}/snapshots")
        number = 1 + max((int(s.getPath().getName()) for s in self._fs.listStatus(folder)), default=0) if self._fs.exists(folder) else 1
        return self._put("\n".join([attempt, *inside]), attempt, f"snapshots/{number}")

    def commit(self, batch: str, changes: DataFrame, versions: Iterable[str] | Mapping[str, Callable[[Column], Column]]) -> bool:
        """Apply one batch; False, with nothing changed, when it is committed already.

        ``changes`` has doc_id, op (``upsert`` or ``delete``), seq, source, lang and
        text. The last change of a document by ``seq`` counts; of equal ones a
        deletion, then the greatest source, lang and counts. An upsert replaces all rows
        of its document, so a document that moves to another source is taken off the
        old one. Deleting an unknown document does nothing. Changes without doc_id or
        with another op are left out. Null source and language are groups of their
        own; a null text counts 0 tokens. ``versions`` names versions of ``count_tokens``, or
        maps names to functions of the text that count, such as ``tokenizer_version(path)``. Other columns are not read. Batch names are
        letters, digits, ``_`` and ``-``.
        """
        if not batch.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"batch name {batch!r}")
        if batch in self.committed():
            return False
        named = dict(versions) if isinstance(versions, Mapping) else {v: partial(count_tokens, version=v) for v in versions}
        counts = [f"n{i}" for i in range(len(named))]
        counted = changes.filter(F.col("doc_id").isNotNull() & F.col("op").isin("upsert", "delete")).select(
            "doc_id",
            "seq",
            (F.col("op") == "delete").alias("gone"),
            "source",
            "lang",
            F.col("text").isNotNull().alias("_has"),
            *(count(F.col("text")).alias(n) for n, count in zip(counts, named.values())),
        )
        # Counts are made before the shuffle; texts never move and are read once. Ties end with the counts.
        best = F.struct("seq", "gone", "source", "lang", "_has", *counts)
        attempt = uuid.uuid4().hex
        counted.groupBy("doc_id").agg(F.max(best).alias("c")).select("doc_id", "c.*").write.parquet(
            f"{self.path}/changes/{batch}-{attempt}"
        )
        last = self.spark.read.parquet(f"{self.path}/changes/{batch}-{attempt}")
        of_version = (F.struct(F.lit(v).alias("version"), F.col(n).alias("tokens")) for v, n in zip(named, counts))
        new = last.select("doc_id", "gone", "source", "lang", F.explode(F.array(*of_version)).alias("v")).select(
            "doc_id", "gone", "source", "lang", "v.version", "v.tokens"
        )
        plus = new.filter("NOT gone").select(*STATE, F.lit(1).alias("sign"))
        minus = self.current(last).select(*STATE, F.lit(-1).alias("sign"))
        rows = (
            plus.unionByName(minus)
            .groupBy(*STATE)
            .agg(F.sum("sign").cast("int").alias("sign"))
            .filter("sign != 0")
            .withColumn("batch", F.lit(batch))
        )
        self._store(rows, f"{batch}-{attempt}")
        return self._seal(batch, attempt)

    def _seal(self, batch: str, attempt: str) -> bool:
        """Make an attempt count, unless another one of the batch already does."""
        return self._put(attempt, f"{batch}-{attempt}", f"commits/{batch}")

    def _put(self, content: str, attempt: str, target: str) -> bool:
        """A small file that appears whole or not at all; False if the target is there."""
        made = self._path(f"{self.path}/attempts/{attempt}")
        out = self._fs.create(made, False)
        out.write(bytearray(content.encode()))
        out.close()
        commit = self._path(f"{self.path}/{target}")
        self._fs.mkdirs(commit.getParent())
        # A store's rename refuses an existing target; a local folder may not, so look first.
        return not self._fs.exists(commit) and self._fs.rename(made, commit)
