"""Every query against its SQL on the small tables."""

import os

import duckdb
import pytest

from docrecon.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR)
    if name not in ORACLES:
        assert got.count() > 0
        return
    cols = sorted(got.columns)
    want = con.execute(ORACLES[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == cols
    rows = sorted((tuple(map(repr, (dict(zip(order, r, strict=True))[c] for c in cols))) for r in want.fetchall()))
    assert sorted(tuple(map(repr, (r[c] for c in cols))) for r in got.collect()) == rows
    assert rows
