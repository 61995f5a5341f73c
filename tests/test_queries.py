"""Every registered query runs on the smallest tables and, where it has SQL, agrees with it."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
from check_queries import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.toArrow().to_pylist()
    assert len(set(df.columns)) == len(df.columns)
    if name not in SQL:
        assert got
        return
    want = duck.execute(SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r.values()) for r in got]) == rows_of(want.column_names, [tuple(r.values()) for r in want.to_pylist()])


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns == ["key", "id", "composite", "rank_in_group"]
