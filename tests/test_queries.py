"""Every query with SQL against DuckDB on the smallest tables; plans of native operators."""

import math
import os

import duckdb
import pytest

from fairlead.plans import fixtures, queries, sql
from fairlead.operators import behaviour

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def rows(columns, data):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = getattr(queries, name)(spark, SMALL)
    told = duck.sql(sql.ORACLES[name])
    data = [[float(v) if type(v).__name__ == "Decimal" else v for v in r] for r in told.fetchall()]
    assert rows(found.columns, found.collect()) == rows(told.columns, data)


def test_native_operators_have_no_python_in_their_plan(spark):
    plan = behaviour.analyse(fixtures.tracks(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning(vessel_id") == 1  # windows and the aggregate share it


def test_model_queries_are_bounded(spark):
    for query in (queries.temporal_scores, queries.iforest_scores):
        values = [r[1] for r in query(spark, SMALL).collect()]
        assert values and all(0 <= v <= 1 for v in values)


def test_entry_is_ranked(spark):
    scores = [r["overall_score"] for r in queries.ranked_risk(spark, SMALL).collect()]
    assert len(scores) == 15 and scores == sorted(scores, reverse=True)
