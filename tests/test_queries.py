"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import check
from conftest import SMALL, plan

import __spark_entry__ as entry
from marshlight.plans import all_queries

QUERIES = all_queries()

# Trees are the only Python steps.
PYTHON = {"st_09c_three_models", "st_18_score_table", "sl_05_best_set"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    """Values equal the SQL's; no cross join; no Python but for the trees."""

    def inspect(df):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        if name not in PYTHON:
            assert "InPandas" not in text and "EvalPython" not in text

    ok, note = check(spark, con, QUERIES[name], SMALL, inspect)
    assert ok, note


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["time", "region", "km2"]
    assert df.count() > 0


def test_registry_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
