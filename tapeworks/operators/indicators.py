"""Technical indicators over bars (mint, bar_start, open, high, low, close)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import recurrences


def by_bar() -> Window:
    return Window.partitionBy("mint").orderBy("bar_start")


def bollinger(bars: DataFrame, length: int, width: float, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Position in the bands (bbp), their width (bbb) and signal; null until `length` bars. Population deviation."""
    w = by_bar().rowsBetween(1 - length, 0)
    full = F.count("close").over(w) == length
    mid, dev = F.avg("close").over(w), F.stddev_pop("close").over(w)
    rows = bars.withColumns({"mid": F.when(full, mid), "_d": F.when(full, dev) * width})
    rows = rows.withColumns({"bbp": F.try_divide(F.col("close") - F.col("mid") + F.col("_d"), 2 * F.col("_d")), "bbb": F.try_divide(200 * F.col("_d"), "mid")}).drop("_d")
    return rows.withColumn("signal", F.when(F.col("bbp") < low, 1).when(F.col("bbp") > high, -1).otherwise(0))


def ema(bars: DataFrame, length: int) -> DataFrame:
    """(mint, bar_start, ema): null before `length` bars, then their mean, then the recurrence."""
    return recurrences.average(bars, "close", length, "ema").select("mint", "bar_start", "ema")


def spread_zscore(pairs: DataFrame) -> DataFrame:
    """Rows (k, i, x, y) by position: hedge ratio of y on x, and z-score of the last residual per k."""
    fit = pairs.groupBy("k").agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"))
    rows = pairs.join(fit, "k").withColumn("r", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"))
    out = rows.groupBy("k").agg(F.first("beta").alias("beta"), F.first("alpha").alias("alpha"), F.max_by("r", "i").alias("last"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    return out.select("k", "alpha", "beta", F.when(F.col("s") > 1e-12, (F.col("last") - F.col("m")) / F.col("s")).alias("zscore"))


def inventory_skew(current: Column, low: Column, high: Column, least: float) -> tuple[Column, Column]:
    """Factors for buys and sells by where the inventory is in its band; both 1 for an empty band."""
    clamp = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(least))
    empty = high <= low
    return F.when(empty, 1.0).otherwise(clamp(F.try_divide(high - current, high - low))), F.when(empty, 1.0).otherwise(clamp(F.try_divide(current - low, high - low)))
