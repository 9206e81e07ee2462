"""Search predicates and pages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a page.
PAGE_ROWS = 1000


def search(df: DataFrame, equal: Mapping[str, object] | None = None, within: Mapping[str, Iterable] | None = None, between: tuple[str, object, object] | None = None) -> DataFrame:
    """Conjunction of optional predicates; empty arguments leave their predicate out, bounds are closed."""
    parts: list[Column] = [F.col(k) == v for k, v in (equal or {}).items() if v not in (None, "")]
    parts += [F.col(k).isin(list(v)) for k, v in (within or {}).items() if v]
    if between:
        name, low, high = between
        parts += [F.col(name) >= low] * (low is not None) + [F.col(name) <= high] * (high is not None)
    return df.where(reduce(Column.__and__, parts)) if parts else df


def newest(df: DataFrame, by: list[str], limit: int, offset: int = 0) -> DataFrame:
    if not 0 < limit <= PAGE_ROWS:
        raise ValueError(f"a page has 1 to {PAGE_ROWS} rows")
    page = df.orderBy(*[F.desc(c) for c in by])
    return (page.offset(offset) if offset else page).limit(limit)


def before(df: DataFrame, by: list[str], cursor: tuple) -> DataFrame:
    """Rows that follow the cursor's row in descending order of the columns `by`."""
    steps = [reduce(Column.__and__, [F.col(c) == v for c, v in zip(by[:i], cursor)] + [F.col(by[i]) < cursor[i]]) for i in range(len(by))]
    return df.where(reduce(Column.__or__, steps))


def any_text(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring search in any of the columns."""
    return df.where(reduce(Column.__or__, [F.lower(F.col(c)).contains(needle.lower()) for c in columns]))


def first_breach(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition holds, else null."""
    (name, cond), *rest = rules
    return reduce(lambda c, r: c.when(r[1], r[0]), rest, F.when(cond, name))
