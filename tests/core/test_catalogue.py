"""Each query with SQL against DuckDB over the smallest driver tables, where they are there."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from granary import catalogue

SF = Path("/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, str(SF))
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(duck.sql(f"select {quoted} from ({catalogue.oracle_sql()[name]}) q").fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql_give_rows(spark, name):
    assert catalogue.queries()[name](spark, str(SF)).count() > 0
