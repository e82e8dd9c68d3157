"""Each twin against its SQL on DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from strandspark import twins

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(twins.queries()))
def test_twin(spark, duck, sf_dir, name):
    got = twins.queries()[name](spark, sf_dir)
    want = duck.execute(twins.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert sorted(names) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(rows, names)
    assert rows
