"""Spark against DuckDB on the same tables: rows as sorted lists of plain values."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.date()
    return round(v, 6) if isinstance(v, float) else v


def compare(spark_df, sql: str, sf_dir: str) -> str:
    """'' if equal, or what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()], key=repr)
    got = sorted([tuple(plain(r[c]) for c in order) for r in spark_df.collect()], key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        for c, x, y in zip(order, a, b):
            if type(x) is not type(y) or (x != y and not (isinstance(x, float) and abs(x - y) <= 2e-6 * max(1, abs(x)))):
                return f"{c}: {x!r} against {y!r} in {a} / {b}"
    return ""
