"""Every query runs, and gives the rows of its SQL."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from textloom.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def con(data):
    out = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        out.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return out


def plain(v):
    return (None if math.isnan(v) else v + 0.0) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, con, name):
    got = QUERIES[name](spark, data)
    columns = sorted(got.columns)
    rows = Counter(str(plain(tuple(r))) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    if name not in SQL:
        assert rows
        return
    r = con.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert rows == Counter(str(plain(tuple(x[names.index(c)] for c in columns))) for x in r.fetchall())


def test_entry_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
