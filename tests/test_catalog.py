"""Each registered query against its SQL, over the whole tables of sf0.001."""

import glob
import os

import pytest

from loomtext.plans.catalog import CATALOG

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET temp_directory=''")
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(n for n, (_, s) in CATALOG.items() if s))
def test_equals_sql(spark, sql, name):
    query, text = CATALOG[name]
    df = query(spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sql.sql(text)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, (_, s) in CATALOG.items() if not s and n != "k_means"))
def test_runs(spark, name):
    assert CATALOG[name][0](spark, DIR).count() > 0
