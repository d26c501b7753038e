from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts (or whole rows), in three partitions."""

    def make(texts, partitions=3):
        rows = [
            (i, t, "en", "src0", None if t is None else len(t)) if not isinstance(t, tuple) else t
            for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, DOCS).repartition(partitions)

    return make
