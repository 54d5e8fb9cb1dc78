"""Every catalogue query against its SQL form on the smallest tables."""
import importlib.util

import duckdb
import pytest

import __spark_entry__ as e
from tests.check_catalog import TABLES, compare

SF = "/root/testdata/sf0.001"
LLM = set()
if importlib.util.find_spec("spliceweave.llm"):  # these have tests of their own
    LLM = {n for n in e.queries() if n.startswith("op") or n == "pipeline"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in e.queries() if n not in LLM])
def test_query_matches_sql(spark, con, name):
    verdict = compare(spark, con, SF, name)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert e.entry(spark).count() > 0
