"""Every registered query of the library runs on the smallest tables; names of columns match those of its SQL."""

import os

import duckdb
import pytest

from hearken import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rounded(v):
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows, cols = df.collect(), df.columns
    if name not in catalog.SQL:
        assert rows
        return
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == sorted(cols)
    order = [cols.index(c) for c in sorted(cols)]
    other = [rel.columns.index(c) for c in sorted(cols)]
    got = sorted((tuple(rounded(r[i]) for i in order) for r in rows), key=repr)
    want = sorted((tuple(rounded(r[i]) for i in other) for r in rel.fetchall()), key=repr)
    assert got == want
