"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return [names[i] for i in order], sorted(tuple(repr(plain(r[i])) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(entry.core_oracle.ORACLE))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(entry.core_oracle.ORACLE[name])
    want = rows([d[0] for d in want.description], want.fetchall())
    got = entry.core_queries.QUERIES[name](spark, ROOT)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want
