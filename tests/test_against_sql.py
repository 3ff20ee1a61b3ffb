"""Every query that has SQL gives the same rows as that SQL, without cross products or Python in its plan."""

from __future__ import annotations

import pytest

from compare import connect, differences
from folio.catalog.oracle import all_oracles
from folio.catalog.queries import all_queries

QUERIES, SQL = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck(data_dir):
    return connect(data_dir)


def test_every_statement_has_its_query():
    assert set(SQL) == set(QUERIES)


UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "MapInPandas", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data_dir, duck, name):
    df = QUERIES[name](spark, data_dir)
    assert differences(df, duck, SQL[name]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [bad for bad in UNWANTED if bad in plan] == []


def test_column_inventory_counts_filled_cells(spark, data_dir):
    import pandas as pd

    from folio.sources.binding import book

    got = {(r.table_name, r.column_name): r.filled_rows for r in QUERIES["audit_columns"](spark, data_dir).collect()}
    for table, df in book(spark, data_dir).spine().items():
        frame = df.toPandas()
        for column in frame.columns:
            assert got.pop((table, column)) == int(pd.notna(frame[column]).sum()), (table, column)
    assert not got
