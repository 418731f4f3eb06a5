"""Run a registered query and its SQL over the same tables; rows as sets of texts."""

from collections import Counter
from pathlib import Path

import duckdb


def views(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def shown(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([shown(v) for v in value])
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(shown(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())
