"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import glob
import os

import duckdb
import pytest

from quillspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: round(x, 9) if isinstance(x, float) else None if x is None else str(x)
    return sorted([tuple(value(r[i]) for i in order) for r in rows], key=str), sorted(names)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    out = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in out.description]
    assert _canon(rows, df.columns) == _canon(out.fetchall(), names)
