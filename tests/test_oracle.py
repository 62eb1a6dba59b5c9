"""Every query with SQL against DuckDB on the smallest tables; those without must give rows."""

import math
import os

import duckdb
import pytest
from cloudloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
