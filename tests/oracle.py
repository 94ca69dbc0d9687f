"""Compares queries with their SQL, as sets of rows under sorted column names."""

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def sql_rows(sql, sf_dir):
    with duckdb.connect() as c:
        c.sql("SET TimeZone = 'UTC'")
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        out = c.sql(sql)
        names = out.columns
        order = sorted(range(len(names)), key=names.__getitem__)
        return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in out.fetchall())


def spark_rows(df):
    names = df.columns
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in df.collect())


def compare(spark, query, sql, sf_dir):
    names, got = spark_rows(query(spark, sf_dir))
    wanted_names, want = sql_rows(sql, sf_dir)
    assert names == wanted_names, (names, wanted_names)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3], sum(got.values()), sum(want.values()))
