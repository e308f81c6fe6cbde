"""Comparison of a query's rows with those of its SQL."""

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def database(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    return con


def assert_same(df, con, sql):
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    left = Counter(str([plain(r[c]) for c in order]) for r in df.collect())
    right = Counter(str([plain(r[names.index(c)]) for c in order]) for r in result.fetchall())
    assert left - right == Counter() and right - left == Counter()
