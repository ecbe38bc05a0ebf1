"""Training-data queries against SQL where there is some, else that they run over the whole tables."""

from __future__ import annotations

import pytest

from normlake.llm import queries as Q
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, name):
    if name in Q.SQL:
        compare(spark, connect(DATA), Q.QUERIES[name], Q.SQL[name], DATA)
    else:
        got = Q.QUERIES[name](spark, DATA)
        assert got.count() == got.distinct().count()
