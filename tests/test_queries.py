"""Every registered query of the core runs, and equals its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name in SQL:
        r = duck.execute(SQL[name])
        want = r.fetchall()
        assert table(df.columns, rows) == table([c[0] for c in r.description], want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
