"""Scalar functions on columns that several operators share; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_seconds(t: Column) -> Column:
    """Epoch seconds of a time in seconds, milli-, micro- or nanoseconds, told apart by magnitude; null below all."""
    t = t.cast("double")
    return F.when(t >= 1e18, t / 1e9).when(t >= 1e15, t / 1e6).when(t >= 1e12, t / 1e3).when(t >= 1e9, t)


def named(code: Column, names: Mapping[object, str], other: str) -> Column:
    """The name of a code, or `other` for null and unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit(other))


def matches(topic: Column, pattern: str) -> Column:
    """Whether a topic of levels between slashes matches a pattern: `+` is one level, `#` all further ones."""
    levels = ["[^/]+" if p == "+" else ".*" if p == "#" else re.escape(p) for p in pattern.split("/")]
    return topic.rlike("^" + "/".join(levels) + "$")


def percent(part: Column, whole: Column) -> Column:
    """The share in hundredths, 0 of nothing."""
    return F.coalesce(F.try_divide(part * 100, whole), F.lit(0.0))


def finite(x: Column) -> Column:
    """x, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def relative(a: Column, b: Column) -> Column:
    """The distance of b from a as a share of a; null unless a is positive."""
    return F.when(a > 0, F.abs(b - a) / a)


def unwrapped(token: Column, prefix: str = "W") -> Column:
    """A token's name without the prefix of its wrapped form."""
    return F.when(token.startswith(prefix), F.substr(token, F.lit(len(prefix) + 1))).otherwise(token)
