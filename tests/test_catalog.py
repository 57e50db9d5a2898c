"""Every registered query against its DuckDB counterpart on the smallest tables."""

import pytest
from conftest import DATA, plain, rows_of

from tessera.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = rows_of(df)
    if name not in ORACLES:
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert found == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_filters_and_prune_columns(spark):
    plan = QUERIES["point_read"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in plan or "EqualTo(doc_id,7)" in plan
    assert "source" not in plan.split("ReadSchema:")[1].splitlines()[0]
    plan = QUERIES["bm25_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
