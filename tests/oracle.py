"""Compares a registered query with its SQL in DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    names = sorted(columns)
    return names, sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)


def agree(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    names, expected = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == expected
