"""Rows of a Spark query and of SQL over the same Parquet tables, made comparable."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v: object) -> object:
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def spark_rows(df) -> tuple[list[str], list]:  # noqa: ANN001
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
