"""Every query of the core against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

from sentria.plans import registry

BASE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{BASE}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    value = lambda x: "null" if x is None or (isinstance(x, float) and math.isnan(x)) else str(x)
    return cols, sorted(tuple(map(value, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, con, name):
    got = registry.QUERIES[name](spark, BASE)
    assert len(set(got.columns)) == len(got.columns)
    if name in registry.ORACLE_SQL:
        assert rows(got.toPandas()) == rows(con.execute(registry.ORACLE_SQL[name]).df())
    else:
        assert got.count() > 0


def test_every_sql_has_its_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
