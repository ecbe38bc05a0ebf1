"""Every query of the core with SQL, over the whole tables of the smallest data."""

from __future__ import annotations

import importlib

import pytest

from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"
MODULES = ("orphan_queries", "table_queries", "retrieval_queries", "graph_queries", "text_queries")
CASES = [(m, k) for m in MODULES for k in importlib.import_module(f"normlake.plans.{m}").QUERIES]


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize(("module", "name"), CASES)
def test_query(spark, con, module, name):
    m = importlib.import_module(f"normlake.plans.{module}")
    if name in m.SQL:
        compare(spark, con, m.QUERIES[name], m.SQL[name], DATA)
    else:
        assert m.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
