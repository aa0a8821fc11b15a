"""Compares a registered query with its SQL, as rows without an order."""

import datetime
import os

import duckdb


def value(v):
    if v is None or v != v:
        return None
    if isinstance(v, (bool, str, bytes)):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if hasattr(v, "__len__"):
        return [value(x) for x in v]
    return value(v.item()) if hasattr(v, "item") else v


def rows(columns, data):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([value(r[i]) for i in at]) for r in data)


def compare(df, sql, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())
