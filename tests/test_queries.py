"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import pytest

from leadweave.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.exists(DIR):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(cols).collect())
    if name not in catalog.ORACLE_SQL:
        return
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
