import duckdb
import pytest

import __spark_entry__ as entry
from verdigris import coverage, queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    """The rows of SQL, by generated code: none that does not compile is forgiven."""
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    if name not in queries.ORACLE:
        assert rows
        return
    result = duck.sql(queries.ORACLE[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).collect()[0]["n"] == 103
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLE) <= set(entry.oracle_sql())
