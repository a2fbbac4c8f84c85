"""Every query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, shown
from reviewlens.plans.oracle import SMALL_TABLES

ORACLE = {**oracle_sql(), **SMALL_TABLES}


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, sf_dir, db, name):
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    assert rows
    if name in ORACLE:
        wanted = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE[name]})")
        assert shown(rows) == shown(wanted.fetchall())


def test_every_counterpart_has_a_query():
    assert set(ORACLE) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 20
