"""Every query against DuckDB, on the smallest tables."""

import duckdb
import pytest

from tidewell.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["model_csv_rows", "model_diagnostics"])
def test_equals_sql_beyond_exact_sums(spark, tmp_path, name):
    """Sums beyond 2^53 depend on the order of additions: DuckDB adds by key in one thread, in no fixed order in several."""
    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql(f"COPY (SELECT 100000000 + i AS o_orderkey, 'O' AS o_orderstatus FROM range(60000) t(i)) TO '{tmp_path}/orders.parquet'")
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), c.sql(SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
