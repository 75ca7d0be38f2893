"""Every registered query runs on the small tables; those with SQL agree with it."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in oracle_sql():
        cur = con.execute(oracle_sql()[name])
        want = rows_of([d[0] for d in cur.description], cur.fetchall())
        assert got == want
    elif not name.startswith("train_models"):
        assert got


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["series_id", "bucket", "min", "avg", "max"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_human_bytes_beyond_a_tebibyte(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT event_id + 10000000 AS event_id, user_id + 100000 AS user_id FROM '{SF}/events.parquet'")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    df = queries()["human_bytes"](spark, str(tmp_path))
    cur = con.execute(oracle_sql()["human_bytes"])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
