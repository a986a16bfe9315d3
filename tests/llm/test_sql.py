"""The queries of this subpackage that SQL can express, against their SQL."""

import glob
import os

import pytest

from sentria.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import rows

BASE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert rows(QUERIES[name](spark, BASE).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())
