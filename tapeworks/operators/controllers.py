"""Arithmetic of trading controllers: spreads of two series, imbalances, inventory, ladders, grids, backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import relative


def last_by_position(series: DataFrame, n: int) -> DataFrame:
    """(k, i, value): each key's last n values of (k, at, value) numbered from the oldest; keys with fewer are left out."""
    w = Window.partitionBy("k").orderBy(F.desc("at"))
    rows = series.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return rows.withColumn("_c", F.count("*").over(Window.partitionBy("k"))).where(F.col("_c") == n).select("k", (n - F.col("_r")).alias("i"), "value")


def growth(rows: DataFrame, value: str) -> Column:
    """Product of (1 + return) up to each row, over that of the first return; null for the first row, which has none.

    Equal to the value over the second one; summed as logarithms, so values must be positive.
    """
    at = Window.partitionBy("k").orderBy("i")
    step = F.ln(F.col(value)) - F.ln(F.lag(value).over(at))
    return F.exp(F.sum(F.when(F.col("i") > 1, step).otherwise(F.when(F.col("i") == 1, 0.0))).over(at.rowsBetween(Window.unboundedPreceding, 0)))


def pair_spread(dominant: DataFrame, hedge: DataFrame, n: int, threshold: float) -> DataFrame:
    """(k, alpha, beta, spread, zscore, signal) of two series (k, at, value), matched by position in their last n values.

    Both are turned into growth since their first return; the hedge is regressed on the dominant one, the spread is the
    percentage off the prediction. The signal is 1 above the threshold, -1 below its negative; null without deviation.
    """
    both = last_by_position(dominant, n).withColumnRenamed("value", "x").join(last_by_position(hedge, n).withColumnRenamed("value", "y"), ["k", "i"])
    both = both.withColumns({"gx": growth(both, "x"), "gy": growth(both, "y")}).where("i > 0")
    fit = both.groupBy("k").agg(F.regr_slope("gy", "gx").alias("beta"), F.regr_intercept("gy", "gx").alias("alpha"))
    rows = both.join(fit, "k").withColumn("_p", F.col("alpha") + F.col("beta") * F.col("gx")).withColumn("s", (F.col("gy") - F.col("_p")) / F.col("_p") * 100)
    out = rows.groupBy("k").agg(F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), F.max_by("s", "i").alias("spread"), F.avg("s").alias("_m"), F.stddev_pop("s").alias("_d"))
    z = F.when(F.col("_d") > 1e-12, (F.col("spread") - F.col("_m")) / F.col("_d"))
    return out.withColumn("zscore", z).withColumn("signal", F.when(F.col("zscore") > threshold, 1).when(F.col("zscore") < -threshold, -1).when(F.col("zscore").isNotNull(), 0)).drop("_m", "_d")


def imbalance(dominant: Column, hedge: Column, ratio: float, most: float) -> dict[str, Column]:
    """Plain and scaled imbalance of two positions, the scaled one's share, and the side that takes no more orders."""
    scaled = dominant - hedge * ratio
    share = F.coalesce(F.try_divide(scaled, dominant), F.lit(0.0))
    return {"imbalance": dominant - hedge, "scaled": scaled, "share": share, "blocked": F.when(share > most, "dominant").when(share < -most, "hedge")}


def inventory(held: Column, result: Column, total: Column, target: float) -> dict[str, Column]:
    """Deviation from the target position, share of the total, and result as a share of what is held; 1, 0, 0 without a position."""
    goal = total * target
    return {"deviation": F.coalesce((goal - held) / goal, F.lit(1.0)), "base_pct": F.coalesce(held / total, F.lit(0.0)), "pnl_pct": F.coalesce(F.try_divide(result, held), F.lit(0.0))}


def ladder(rows: DataFrame, spreads: list[float], multiplier: float, buy_factor: Column, sell_factor: Column, amount: Column) -> DataFrame:
    """Orders of each row's levels on both sides: price away from `reference` by the level's spread, amount times the side's factor."""
    table = [F.struct(F.lit(side).alias("side"), F.lit(i).alias("level"), F.lit(s * multiplier).alias("spread")) for side in ("BUY", "SELL") for i, s in enumerate(spreads)]
    out = rows.withColumns({"_buy": buy_factor, "_sell": sell_factor, "_amount": amount}).withColumn("_l", F.explode(F.array(*table)))
    buy = F.col("_l.side") == "BUY"
    price = F.col("reference") * (1 + F.when(buy, -F.col("_l.spread")).otherwise(F.col("_l.spread")))
    return out.withColumns({"side": F.col("_l.side"), "level": F.col("_l.level"), "price": price, "amount": F.col("_amount") * F.when(buy, F.col("_buy")).otherwise(F.col("_sell"))}).drop("_l", "_buy", "_sell", "_amount")


def open_levels(wanted: DataFrame, active: DataFrame, keys: list[str], share: Column, low: float, high: float) -> DataFrame:
    """Levels that have no active order, only buys below the band of the inventory's share and only sells above it."""
    missing = wanted.join(active, [*keys, "side", "level"], "left_anti")
    return missing.where(~((share < low) & (F.col("side") == "SELL")) & ~((share > high) & (F.col("side") == "BUY")))


def parts_of(amounts: Column, total: Column) -> Column:
    """The total dealt out in proportion to an array of amounts, equally where all are null."""
    whole = F.aggregate(amounts, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.transform(amounts, lambda x: F.coalesce(F.try_divide(x, whole), 1.0 / F.size(amounts)) * total)


def grid(close: Column, width: Column, signal: Column, start: float, end: float, limit: float) -> dict[str, Column]:
    """Start, end and limit price of a grid around the close, by the bands' width (a share) and the signal; null without one."""
    long, short = signal == 1, signal == -1
    at = lambda k: close * (1 + width * k)
    return {
        "start_price": F.when(short, at(-end)).when(long, at(-start)), "end_price": F.when(short, at(start)).when(long, at(end)), "limit_price": F.when(short, at(limit)).when(long, at(-limit)),
    }


def backtest(returns: DataFrame, key: str, at: str, value: str, periods: float) -> DataFrame:
    """Total and mean return, deviation, Sharpe ratio (0 without deviation) and the greatest fall of the running total."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("_sum", F.sum(value).over(w)).withColumn("_fall", F.greatest(F.max("_sum").over(w), F.lit(0.0)) - F.col("_sum"))
    mean, dev = F.avg(value), F.stddev_pop(value)
    return rows.groupBy(key).agg(
        F.count("*").alias("trades"), F.sum(value).alias("total"), mean.alias("mean"), dev.alias("deviation"), F.coalesce(F.when(dev > 1e-12, mean / dev * periods**0.5), F.lit(0.0)).alias("sharpe"), F.max("_fall").alias("max_fall")
    )


def divergence(rows: DataFrame, keys: list[str], a: str, b: str, steps: dict[str, float]) -> DataFrame:
    """Of each key: how often a or b is missing, compared rows, and how many differ from a by more than each step."""
    gap = relative(F.col(a), F.col(b))
    return rows.groupBy(*keys).agg(F.count_if(F.col(a).isNull()).alias("a_null"), F.count_if(F.col(b).isNull()).alias("b_null"), F.count(gap).alias("compared"), *[F.count_if(gap > s).alias(n) for n, s in steps.items()])


def liquidity(quote: Column, other: Column) -> Column:
    """Twice the quote reserve if there is one, else what another source says."""
    return F.when(quote > 0, 2 * quote).otherwise(other)


def curve_swaps(balances: DataFrame) -> DataFrame:
    """Swaps from balance changes (tx, t, failed, owner, role, lamports, tokens), where roles are `curve` and `signer`.

    The curve's lamports and the signer's tokens must change with the same sign: up is a buy. Failed transactions,
    those without a time and those that move none of either give no swap.
    """
    of = lambda c, role: F.sum(F.when(F.col("role") == role, F.col(c)).otherwise(0))
    rows = balances.where("not failed and t > 0").groupBy("tx", "t").agg(of("lamports", "curve").alias("lam"), of("tokens", "signer").alias("tok"), F.max(F.when(F.col("role") == "signer", F.col("owner"))).alias("trader"))
    rows = rows.where("lam * tok > 0")
    volume, base = F.abs("lam") / 1e9, F.abs("tok")
    return rows.select("tx", "t", "trader", (F.col("lam") > 0).cast("int").alias("is_buy"), volume.alias("volume"), base.alias("base_amount"), (volume / base).alias("price"))
