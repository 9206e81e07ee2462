"""Indicators that each bar's value feeds into the next one's: EMA, MACD, ATR, Supertrend.

Bars are already aggregated, so a mint has one row for a bar's length of time; those of one mint meet in one task. The
linear recurrences are sums in windows; only Supertrend, whose bands depend on which one was crossed, runs in Python.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smoothed(values: np.ndarray, length: int, alpha: float) -> np.ndarray:
    """x[i] = alpha * value + (1 - alpha) * x[i - 1], from the mean of the first `length` values on; NaN before.

    Leading NaNs are skipped.
    """
    out = np.full(len(values), np.nan)
    known = np.flatnonzero(~np.isnan(values))
    if len(known) < length:
        return out
    first = known[0] + length - 1
    x = out[first] = values[known[0] : first + 1].mean()
    for i in range(first + 1, len(values)):
        x = out[i] = alpha * values[i] + (1 - alpha) * x
    return out


def ema(values: np.ndarray, length: int) -> np.ndarray:
    return smoothed(values, length, 2 / (length + 1))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, length: int) -> np.ndarray:
    """Wilder's average true range; the first bar's range is high less low."""
    before = np.concatenate((close[:1], close[:-1]))
    true = np.maximum(high - low, np.maximum(abs(high - before), abs(low - before)))
    return smoothed(true, length, 1 / length)


def supertrend_of(high: np.ndarray, low: np.ndarray, close: np.ndarray, length: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The line and its direction: bands around the middle that only tighten until the close crosses one."""
    mid, reach = (high + low) / 2, width * atr(high, low, close, length)
    up, down = mid + reach, mid - reach
    line, direction = np.full(len(close), np.nan), np.zeros(len(close), np.int64)
    way = 1
    for i in range(len(close)):
        if np.isnan(reach[i]):
            continue
        if i and not np.isnan(up[i - 1]):
            if close[i] > up[i - 1]:
                way = 1
            elif close[i] < down[i - 1]:
                way = -1
            if way > 0:
                down[i] = max(down[i], down[i - 1])
            else:
                up[i] = min(up[i], up[i - 1])
        direction[i] = way
        line[i] = down[i] if way > 0 else up[i]
    return line, direction


#: Natural logarithm by which an old value's weight has fallen at the end of a part: 1e-20, and it still counts for another part.
FADED = 46.0


def recurrence(bars: DataFrame, value: str, length: int, alpha: float, name: str) -> DataFrame:
    """Add x[i] = alpha * value + (1 - alpha) * x[i - 1] of each mint, from the mean of its first `length` values on; null before and where value is null.

    A value's step is the affine map x -> alpha * value + q * x, q = 1 - alpha. A mint's steps are cut into parts; inside one the maps compose to
    x -> y + q^(r + 1) * x, in which y is a running sum of values weighted by powers of q. A part starts from the ends of the two before it, for
    over a whole part a weight fades to 1e-20 and over two to 1e-40, which a double can't hold beside the rest.
    """
    q = 1 - alpha
    size = ceil(FADED / -log(q)) if q > 0 else 1
    mint = Window.partitionBy("mint")
    rows = bars.withColumn("_i", F.when(F.col(value).isNotNull(), F.count(value).over(mint.orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)) - 1))
    rows = rows.withColumn("_seed", F.avg(F.when(F.col("_i") < length, F.col(value))).over(mint))
    step = F.when(F.col("_i") >= length, F.col("_i") - length)
    rows = rows.withColumns({"_m": F.floor(step / size), "_r": step % size})
    part = Window.partitionBy("mint", "_m").orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda e: F.pow(F.lit(q), e)
    rows = rows.withColumn("_y", power(F.col("_r")) * F.sum(alpha * F.col(value) / power(F.col("_r"))).over(part))
    end = F.max(F.when(F.col("_r") == size - 1, F.col("_y")))
    along = mint.orderBy("_m")
    rows = rows.withColumns({"_e1": end.over(along.rangeBetween(-1, -1)), "_e2": end.over(along.rangeBetween(-2, -2))})
    start = F.when(F.col("_m") == 0, F.col("_seed")).otherwise(F.col("_e1") + q**size * F.when(F.col("_m") == 1, F.col("_seed")).otherwise(F.col("_e2")))
    x = F.when(F.col("_i") == length - 1, F.col("_seed")).when(F.col("_m").isNotNull(), power(F.col("_r") + 1) * start + F.col("_y"))
    return rows.withColumn(name, x).drop("_i", "_seed", "_m", "_r", "_y", "_e1", "_e2")


def average(bars: DataFrame, value: str, length: int, name: str) -> DataFrame:
    """Add the exponential moving average of a column."""
    return recurrence(bars, value, length, 2 / (length + 1), name)


def true_range_average(bars: DataFrame, length: int, name: str) -> DataFrame:
    """Add Wilder's average true range; the first bar's range is high less low."""
    before = F.coalesce(F.lag("close").over(Window.partitionBy("mint").orderBy("bar_start")), F.col("close"))
    rows = bars.withColumn("_before", before).withColumn("_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_before")), F.abs(F.col("low") - F.col("_before"))))
    return recurrence(rows, "_range", length, 1 / length, name).drop("_before", "_range")


def by_mint(bars: DataFrame, fn, added: str) -> DataFrame:
    """Add double columns that fn makes of a mint's bars in order of time; NaN becomes null."""
    names = [c.split()[0] for c in added.split(", ")]
    rows = bars.select("mint", "bar_start", "high", "low", "close")
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in rows.columns) + ", " + added

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bar_start", ignore_index=True)
        return group.assign(**dict(zip(names, fn(*(group[c].to_numpy(float) for c in ("high", "low", "close"))))))

    out = rows.groupBy("mint").applyInPandas(run, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in names})


def macd(bars: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    """Bars with macd, macd_signal and macd_hist; null until enough bars."""
    rows = average(average(bars, "close", fast, "_fast"), "close", slow, "_slow")
    rows = rows.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return average(rows, "macd", signal, "macd_signal").withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def macd_bands_signal(bands: DataFrame, lines: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """1 where the close is under `low` of the bands while a negative MACD rises over its signal; -1 mirrored; else 0."""
    rows = bands.select("mint", "bar_start", "bbp").join(lines.select("mint", "bar_start", "macd", "macd_hist"), ["mint", "bar_start"])
    up = (F.col("bbp") < low) & (F.col("macd_hist") > 0) & (F.col("macd") < 0)
    down = (F.col("bbp") > high) & (F.col("macd_hist") < 0) & (F.col("macd") > 0)
    return rows.withColumn("signal", F.when(up, 1).when(down, -1).otherwise(0))


def supertrend(bars: DataFrame, length: int, width: float, near: float) -> DataFrame:
    """Bars with line, direction (0 until enough bars) and the signal: the direction while the close is within `near` of the line."""
    rows = by_mint(bars, lambda h, l, c: supertrend_of(h, l, c, length, width), "line double, direction double")
    distance = F.try_divide(F.abs(F.col("close") - F.col("line")), "close")
    rows = rows.withColumn("direction", F.col("direction").cast("int"))
    return rows.withColumn("signal", F.when(distance < near, F.col("direction")).otherwise(0))


def volatility_shift(bars: DataFrame, length: int, fast: int, slow: int, signal: int) -> DataFrame:
    """Per bar: natr (share of the close) and the reference price, moved against the standardized MACD and with its
    histogram's sign by half the natr at most per unit. The MACD's mean and sample deviation are those of the mint's bars; each
    bar is moved by its own natr (where only the newest bar's price is wanted, take its row)."""

    rows = true_range_average(macd(bars, fast, slow, signal), length, "atr")
    of = Window.partitionBy("mint")
    rows = rows.withColumns({"_m": F.avg("macd").over(of), "_s": F.stddev_samp("macd").over(of)})
    score = -F.try_divide(F.col("macd") - F.col("_m"), "_s")
    way = F.when(F.col("macd_hist") > 0, 1.0).otherwise(-1.0)
    rows = rows.withColumns({"natr": F.try_divide("atr", "close"), "_score": score})
    return rows.withColumn("reference_price", F.col("close") * (1 + (0.5 * F.col("_score") + 0.5 * way) * F.col("natr") / 2)).drop("_score", "_m", "_s")
