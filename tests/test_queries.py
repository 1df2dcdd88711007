"""Every registered query against its independent SQL."""

import pytest

import __spark_entry__ as registry
from codexfold.plans.catalog import QUERIES as CATALOG
from codexfold.plans.oracles import ORACLES as SQL
from codexfold.streaming.live import LIVE

QUERIES = {**CATALOG, **LIVE}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, tables_dir, check_db):
    result = QUERIES[name](spark, tables_dir)
    columns = sorted(result.columns)
    ours = sorted(repr(tuple(row[c] for c in columns)) for row in result.collect())
    answer = check_db.execute(SQL[name])
    theirs = [d[0] for d in answer.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    assert ours == sorted(repr(tuple(row[i] for i in order)) for row in answer.fetchall())
    assert ours


def test_entry(spark):
    assert registry.entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("live_")))
def test_plan_has_no_pair_join(name, spark, tables_dir):
    plan = QUERIES[name](spark, tables_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
