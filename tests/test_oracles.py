"""Every registered query against its oracle SQL on the smallest given tables."""

import importlib.util
import os
from pathlib import Path

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

spec = importlib.util.spec_from_file_location(
    "spark_entry", Path(__file__).parents[1] / "__spark_entry__.py"
)
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows or name in ("check_budget", "expiry_reports", "near_misses")
    cursor = con.execute(entry.oracle_sql()[name])
    named = [c[0] for c in cursor.description]
    assert sorted(named) == columns
    expected = sorted(
        tuple(plain(r[named.index(c)]) for c in columns) for r in cursor.fetchall()
    )
    assert rows == expected
