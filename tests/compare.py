"""Runs a query and its SQL on the same tables and compares sorted rows."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return 0.0 if x == 0 else float(f"{x:.12g}")
    return str(x) if isinstance(x, (datetime.date, datetime.datetime)) else x


def same(spark, sf, query, sql):
    left = query(spark, sf)
    names = sorted(left.columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in left.collect()), key=repr)
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        cursor = db.execute(sql)
        found = [c[0] for c in cursor.description]
        b = sorted((tuple(plain(r[found.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert sorted(found) == names
    assert len(a) == len(b)
    differ = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not differ, differ[:3]
