"""Every query of the subpackage that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lexloom.llm.oracle import ORACLE
from lexloom.llm.queries import QUERIES
from tests.test_oracle import ROOT, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(ORACLE[name])
    want = rows([d[0] for d in want.description], want.fetchall())
    got = QUERIES[name](spark, ROOT)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want
