"""Every query with SQL is compared with DuckDB on the smallest tables; the others have to run."""

import math
import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from riskfeat.plans.catalog import BOOK

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Minutes of model fitting; its parts are covered in test_models.py.
SLOW = {"model_leaderboard"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    yield c
    c.close()


def plain(v):
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(v) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v


def table(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in at) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", [n for n, q in BOOK.items() if q.sql is not None])
def test_matches_sql(spark, con, name):
    df = BOOK[name].run(spark, FOLDER)
    got = table(df.collect(), df.columns)
    cur = con.execute(BOOK[name].sql)
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == table(cur.fetchall(), cols)


@pytest.mark.parametrize("name", [n for n, q in BOOK.items() if q.sql is None and n not in SLOW])
def test_runs(spark, name):
    df = BOOK[name].run(spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_names():
    assert not [n for n in BOOK if n == "pipeline" or n.startswith("op")]
