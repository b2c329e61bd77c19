"""Every registered query against its independent SQL in DuckDB.

The queries run with broadcasting switched off, so their plans are the ones that large
tables would get.
"""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.helpers import physical_plan, sorted_values
from verification import catalog, oracle

SF = "/root/testdata/sf0.001"
# Neither joins of everything with everything nor Python workers.
FORBIDDEN = [
    "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_oracle(spark, duck, name, no_broadcast):
    df = catalog.queries()[name](spark, SF)
    assert not [node for node in FORBIDDEN if node in physical_plan(df)]
    cursor = duck.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted_values(df.columns, [tuple(r) for r in df.collect()]) == sorted_values(columns, cursor.fetchall())
