"""Every registered query with SQL against DuckDB over the smallest tables."""

import datetime
import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr([norm(x) for x in r]) for r in df.select(*cols).collect())
    c = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in c.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
