"""Comparison of a query with its DuckDB SQL on one folder of tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def differences(spark_df, db, sql):
    """None, or what differs first."""
    got_names, got = spark_df.columns, spark_df.collect()
    cursor = db.execute(sql)
    want_names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} and {sorted(want_names)}"
    a, b = rows(got_names, got), rows(want_names, want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; {[x for x in a if x not in set(b)][:2]} {[x for x in b if x not in set(a)][:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(got_names)}: {x} and {y}"
    return None if got else "no rows"
