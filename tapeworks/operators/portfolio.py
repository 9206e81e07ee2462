"""Snapshots of accounts: latest states, values, distributions, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent


def latest(states: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """All rows at the greatest timestamp of their keys, ties included."""
    return states.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))).where("_r = 1").drop("_r")


def distribution(states: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Value, units and share of the total for each grouping of columns in `levels`, in one scan.

    Columns that a level leaves out are null.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    sets = [[F.col(c) for c in level] for level in levels]
    total = states.agg(F.sum("value").alias("_total"))  # one row
    rows = states.groupingSets(sets, *columns).agg(F.sum("value").alias("value"), F.sum("units").alias("units"))
    return rows.join(F.broadcast(total)).withColumn("pct", percent(F.col("value"), F.col("_total"))).drop("_total")


def sampled(states: DataFrame, key: str, seconds: float) -> DataFrame:
    """Newest first, the rows at least `seconds` older than the last one kept; (key, t) with t in seconds.

    One key's distinct times are held in one array.
    """
    times = F.sort_array(F.collect_set("t"), asc=False)
    keep = F.aggregate(times, F.array().cast("array<double>"), lambda kept, t: F.when((F.size(kept) == 0) | (F.element_at(kept, -1) - t >= seconds), F.concat(kept, F.array(t))).otherwise(kept))
    return states.groupBy(key).agg(keep.alias("_t")).select(key, F.explode("_t").alias("t"))
