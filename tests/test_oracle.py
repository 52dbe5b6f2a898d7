"""Every named query with SQL must give the same rows as DuckDB."""

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from reports import SF  # noqa: E402

QUERIES, CHECKS = entry_module.queries(), entry_module.oracle_sql()
TABLES = [p.stem for p in Path(SF).glob("*.parquet")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canonical(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = rows_of(df.columns, df.collect())
    if name not in CHECKS:
        assert sum(found[1].values()) > 0
        return
    cursor = duck.execute(CHECKS[name])
    assert found == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 5
