"""A query's rows against those of its SQL, without order."""

import os

import duckdb
import pandas as pd


def connected(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def _plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v or v is pd.NA:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def rows(frame, types):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if types[c] in ("bigint", "int"):
            frame = frame.assign(**{c: frame[c].astype("Int64")})
        if types[c] in ("date", "timestamp"):
            frame = frame.assign(**{c: pd.to_datetime(frame[c])})
    return sorted(tuple(_plain(v) for v in r) for r in frame.itertuples(index=False))


def same(spark, sf_dir, query, sql):
    found = query(spark, sf_dir)
    types = dict(found.dtypes)
    wanted = connected(sf_dir).sql(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.toPandas(), types) == rows(wanted, types)
