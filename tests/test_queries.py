"""Every query with SQL against DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from docmill.queries import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return float(f"{v:.6g}")
    return v


def canonical(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = canonical(df.select(*columns).collect())
    if name not in ORACLES:
        return
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    want = canonical(relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert len(got) == len(want)
    assert [tuple(map(float, r)) if all(isinstance(x, (int, float)) for x in r) else r for r in got] == [tuple(map(float, r)) if all(isinstance(x, (int, float)) for x in r) else r for r in want]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and df.dtypes == [("vec_id", "bigint"), ("score", "double")]
