"""Spark query against SQL oracle: names, types, row count and values."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
_KINDS = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
    "DATE": "date", "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if equal, else what differs first."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: _KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    types = dict(spark_df.dtypes)
    wrong = {n: (types[n], kinds[n]) for n in names if types[n] != kinds[n]}
    if wrong:
        return f"types {wrong}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    want = _sorted([tuple(_plain(r[i]) for i in at) for r in result.fetchall()])
    got = _sorted([tuple(_plain(v) for v in r) for r in spark_df.select(*[f"`{n}`" for n in order]).collect()])
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            close = all(
                a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9))
                for a, b in zip(g, w)
            )
            return f"{'close' if close else 'different'}: {dict(zip(order, g))} vs {dict(zip(order, w))}"
    return None
