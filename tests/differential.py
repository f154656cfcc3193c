"""Runs a query in Spark and its oracle in DuckDB and compares them as bags of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    names = sorted(df.columns)
    ours = sorted(tuple(shown(v) for v in row) for row in df.select(*[f"`{c}`" for c in names]).collect())
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return f"columns {names} and {sorted(found)}"
    order = [found.index(c) for c in names]
    theirs = sorted(tuple(shown(row[k]) for k in order) for row in cursor.fetchall())
    if ours == theirs:
        return None
    return f"{len(ours)} and {len(theirs)} rows; only ours {sorted(set(ours) - set(theirs))[:2]}, only the oracle's {sorted(set(theirs) - set(ours))[:2]}"
