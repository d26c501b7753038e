"""Every corpus query with SQL against it, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, connect

from pairloom.llm.oracles import ORACLES
from pairloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None
