"""Rows of a Spark query and of its SQL, in one comparable form."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, bool) or not hasattr(x, "as_tuple"):
        return x
    return plain(float(x))


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: repr([float(f"{x:.4g}") if isinstance(x, float) else x for x in r]))


def same(a, b) -> bool:
    """Equal but for the last digit that either side's rounding of a sum can change."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows(df.columns, df.collect())


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        for t in TABLES:
            if Path(path := f"{sf_dir}/{t}.parquet").exists():
                con.execute(f"create view {t} as select * from '{path}'")
        got = con.execute(sql)
        columns = [c[0] for c in got.description]
        return sorted(columns), rows(columns, got.fetchall())
