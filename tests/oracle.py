"""Runs a query and its SQL twin, and compares them as the driver does: column names, row counts, values."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def tidy(x):
    return float(x) if type(x).__name__ == "Decimal" else x + 0.0 if isinstance(x, float) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(tidy(r[k]) for k in order)) for r in data)


def differences(spark, con, query, sql, sf):
    df = query(spark, sf)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} and {rel.columns}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    if a == b:
        return None
    odd = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(a)} and {len(b)} rows; {len(odd)} differ: {odd[:2]}"
