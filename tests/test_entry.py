"""The driver's entry points, and each query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from sijill import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(value):
    return round(value, 6) if isinstance(value, float) else float(value) if type(value).__name__ == "Decimal" else value


@here
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@here
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, name):
    found = core.QUERIES[name](spark, SF)
    if name not in core.ORACLE_SQL:
        assert found.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.sql(core.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.column_names)
    rows = lambda got: sorted((tuple(plain(r[c]) for c in columns) for r in got), key=str)
    assert rows(r.asDict() for r in found.collect()) == rows(wanted.to_pylist())
