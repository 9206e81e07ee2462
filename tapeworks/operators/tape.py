"""Swap tapes: bars, weighted medians and microstructure features.

Tapes have mint, trader, is_buy, volume, price and t (seconds), and seq, the number of a swap, which orders those of one time
(without it their order is open). A mint's swaps inside an analysis window meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles, scans


def order(tape: DataFrame) -> list[str]:
    """The columns that order a tape."""
    return ["t", "seq"] if "seq" in tape.columns else ["t"]


def at(tape: DataFrame) -> Column:
    """A swap's place in a tape, for min_by and max_by."""
    return F.struct(*order(tape))


def by_time(tape: DataFrame, newest: bool = False) -> Window:
    return Window.partitionBy("mint").orderBy(*[F.desc(c) if newest else c for c in order(tape)])


def bars(tape: DataFrame, seconds: float, tail: float = 10) -> DataFrame:
    """Open, high, low, close, volume, counts of each bar; vwap_close over the last `tail` seconds of a bar, else its last price."""
    rows = tape.withColumn("bar", F.floor(F.col("t") / seconds) * seconds)
    late = F.col("t") >= F.col("bar") + seconds - tail
    return rows.groupBy("mint", F.col("bar").cast("long").alias("bar_start")).agg(
        F.min_by("price", at(tape)).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at(tape)).alias("close"), F.sum("volume").alias("volume"),
        F.count("*").alias("trades"), F.count_if(F.col("is_buy") == 1).alias("buys"), F.count_if(F.col("is_buy") == 0).alias("sells"),
        F.coalesce(F.try_divide(F.sum(F.when(late, F.col("price") * F.col("volume"))), F.sum(F.when(late, F.col("volume")))), F.max_by("price", at(tape))).alias("vwap_close"),
    )


def filled(bar_rows: DataFrame, seconds: int) -> DataFrame:
    """Empty bars between a mint's first and last one repeat the close before them, without volume."""
    ends = bar_rows.groupBy("mint").agg(F.min("bar_start").alias("a"), F.max("bar_start").alias("b"))
    grid = ends.select("mint", F.explode(F.sequence("a", "b", F.lit(seconds).cast("long"))).alias("bar_start"))
    before = Window.partitionBy("mint").orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(bar_rows, ["mint", "bar_start"], "left").withColumn("close", F.last("close", ignorenulls=True).over(before))
    flat = {c: F.coalesce(c, "close") for c in ("open", "high", "low")}
    return rows.withColumns(flat | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("volume", "trades", "buys", "sells")})


def weighted_median(tape: DataFrame, weight: Column, least: int = 1) -> DataFrame:
    """Per mint, the first price at which the cumulative weight reaches half; null below `least` swaps."""
    total = tape.groupBy("mint").agg(F.count("*").alias("swaps"), F.sum(weight).alias("_t"))
    levels = tape.groupBy("mint", "price").agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy("mint").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    half = levels.withColumn("_c", F.sum("_w").over(w)).join(total, "mint").where(F.col("_c") >= F.col("_t") / 2)
    price = half.groupBy("mint").agg(F.min("price").alias("_p"))
    return total.join(price, "mint", "left").select("mint", F.when(F.col("swaps") >= least, F.col("_p")).alias("median_price"), "swaps")


def recent_median(tape: DataFrame, rows: int = 7) -> DataFrame:
    latest = tape.withColumn("_r", F.row_number().over(by_time(tape, newest=True))).where(F.col("_r") <= rows)
    return latest.groupBy("mint").agg(F.median("price").alias("median_price"))


def short_trend(tape: DataFrame, low: float, high: float, ends: int = 3, least: int = 5) -> DataFrame:
    """Median of the last prices over that of the first, less 1, and what it says."""
    up, down = by_time(tape), by_time(tape, newest=True)
    rows = tape.withColumns({"_a": F.row_number().over(up), "_b": F.row_number().over(down)})
    out = rows.groupBy("mint").agg(F.count("*").alias("n"), (F.try_divide(F.median(F.when(F.col("_b") <= ends, F.col("price"))), F.median(F.when(F.col("_a") <= ends, F.col("price")))) - 1).alias("trend"))
    trend = F.when(F.col("n") >= least, F.col("trend"))
    return out.select("mint", trend.alias("trend"), F.when(trend < low, "active_dump").when(trend > high, "pump_top").otherwise("neutral").alias("signal"))


def confirmed(tape: DataFrame, seconds: int, share: float = 0.8, least: int = 3) -> DataFrame:
    """Whether at least `least` swaps within `seconds` (itself included) trade at `share` of the price or more."""
    return scans.supported(tape, ["mint"], "t", "price", seconds, share, least, "confirmed")


def branching(tape: DataFrame, seconds: int) -> DataFrame:
    """Successors of the same side within `seconds`, strictly later."""
    return scans.followers(tape, ["mint", "is_buy"], "t", seconds, "successors")


#: Seconds of a slice of a mint's tape, for values that run through all of it.
SLICE = 86_400


def running(tape: DataFrame, **of) -> DataFrame:
    """scans.scan along each mint's tape."""
    return scans.scan(tape, ["mint"], order(tape), F.floor(F.col("t") / SLICE), **of)


def log_returns(tape: DataFrame) -> DataFrame:
    rows = running(tape, before={"_was": F.col("price")})
    return rows.withColumn("log_return", F.ln(F.try_divide("price", "_was"))).drop("_was")


def gaps(tape: DataFrame) -> DataFrame:
    """Seconds since the mint's swap before; null for its first."""
    return running(tape, before={"_was": F.col("t")}).withColumn("gap", F.col("t") - F.col("_was")).drop("_was")


def impact(tape: DataFrame, floor: float = 0.01, least: int = 10) -> DataFrame:
    """Kyle's lambda proxy and Roll's spread per mint."""
    rows = running(tape, before={"_was": F.col("price")})
    rows = rows.withColumn("_d", F.col("price") - F.col("_was")).withColumn("_l", F.abs(F.ln(F.try_divide("price", "_was"))) / F.greatest("volume", F.lit(floor)))
    rows = running(rows, before={"_e": F.col("_d")})
    cov = F.covar_samp("_d", "_e")
    spread = rows.groupBy("mint").agg(F.count("*").alias("_n"), F.when(cov < 0, 2 * F.sqrt(-cov)).otherwise(0.0).alias("roll_spread"))
    made = spread.join(quantiles.exact(rows, ["mint"], "_l", {"_middle": 0.5}), "mint", "left")
    return made.select("mint", F.when(F.col("_n") >= least, F.col("_middle")).alias("kyle_lambda"), "roll_spread")


def vpin(tape: DataFrame, seconds: float, least: int = 3) -> DataFrame:
    """Mean imbalance of buckets with enough trades."""
    b = tape.groupBy("mint", F.floor(F.col("t") / seconds).alias("b")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("is_buy") == 1, F.col("volume")).otherwise(0.0)).alias("buy"), F.sum("volume").alias("v"))
    return b.where(F.col("n") >= least).groupBy("mint").agg(F.avg(F.try_divide(F.abs(2 * F.col("buy") - F.col("v")), "v")).alias("vpin"), F.count("*").alias("buckets"))


def flow(tape: DataFrame) -> DataFrame:
    """Order-flow imbalance, concentration of buyers (HHI, top 3), sizes' moments and percentiles, traders."""
    buyer = tape.where("is_buy = 1").groupBy("mint", "trader").agg(F.sum("volume").alias("v"))
    w = Window.partitionBy("mint")
    buyer = buyer.withColumns({"_s": F.try_divide("v", F.sum("v").over(w)), "_r": F.row_number().over(w.orderBy(F.desc("v"), "trader"))})
    share = buyer.groupBy("mint").agg(F.sum(F.col("_s") * F.col("_s")).alias("hhi"), F.sum(F.when(F.col("_r") <= 3, F.col("_s"))).alias("top3"))
    side = F.when(F.col("is_buy") == 1, F.col("volume")).otherwise(-F.col("volume"))
    total = tape.groupBy("mint").agg(
        F.try_divide(F.sum(side), F.sum("volume")).alias("ofi"), F.avg("volume").alias("mean_size"), F.stddev_pop("volume").alias("std_size"), F.count_distinct("trader").alias("unique_traders"),
    )
    total = total.join(quantiles.exact(tape, ["mint"], "volume", {"p90": 0.9, "p10": 0.1}), "mint", "left")
    return total.join(share, "mint", "left").fillna({"hhi": 1.0, "top3": 1.0})


def streaks(tape: DataFrame) -> DataFrame:
    """Longest run of sells, changes of side, fall of the last price from the highest."""
    rows = running(tape, sums={"_isle": F.col("is_buy")}, before={"_was": F.col("is_buy")})
    runs = rows.groupBy("mint", "_isle").agg(F.count_if(F.col("is_buy") == 0).alias("_run")).groupBy("mint").agg(F.max("_run").alias("sell_streak"))
    rest = rows.groupBy("mint").agg(F.count_if(F.col("is_buy") != F.col("_was")).alias("switches"), (F.max_by("price", at(rows)) / F.max("price") - 1).alias("drawdown"))
    return runs.join(rest, "mint")


def new_buyers(tape: DataFrame, seconds: float) -> DataFrame:
    """Buyers by the bucket in which they first bought."""
    first = tape.where("is_buy = 1").groupBy("mint", "trader").agg(F.min(F.floor(F.col("t") / seconds)).alias("bucket"))
    return first.groupBy("mint", "bucket").agg(F.count("*").alias("new_buyers"))


def new_highs(tape: DataFrame, step: float = 0.05) -> DataFrame:
    """Times that the price exceeds the last counted high by `step`, from the first price on.

    Only rows above all prices before them can count, so only those are collected.
    """
    was = F.max("price").over(Window.partitionBy("mint").orderBy("t", "price").rowsBetween(Window.unboundedPreceding, -1))
    rising = tape.withColumn("_was", was).withColumn("_rises", F.col("price").isNotNull() & (F.col("_was").isNull() | (F.col("price") > F.col("_was"))))
    prices = F.transform(F.sort_array(F.collect_list(F.when(F.col("_rises"), F.struct("t", "price")))), lambda x: x["price"])
    start = F.struct(F.try_element_at("p", F.lit(1)).alias("high"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate("p", start, lambda s, x: F.when(x > s["high"] * (1 + step), F.struct(x.alias("high"), (s["n"] + 1).alias("n"))).otherwise(s))
    return rising.groupBy("mint").agg(prices.alias("p")).select("mint", fold["n"].alias("new_highs"))


def fresh_median(tape: DataFrame, now: Column, seconds: float, rows: int = 7) -> DataFrame:
    """recent_median of the prices that are at most `seconds` old; mints without one have no row."""
    return recent_median(tape.where(F.col("t").between(now - seconds, now)), rows)


def peak_since(tape: DataFrame, since: Column, seconds: int, share: float = 0.8, least: int = 3) -> DataFrame:
    """(mint, peak, swaps): the highest confirmed price of each mint from `since` on; what confirms it may be earlier."""
    later = confirmed(tape, seconds, share, least).where(F.col("t") >= since)
    return later.groupBy("mint").agg(F.max(F.when(F.col("confirmed"), F.col("price"))).alias("peak"), F.count("*").alias("swaps"))


def newest_trend(tape: DataFrame, seconds: float, low: float, high: float, ends: int = 3, least: int = 5) -> DataFrame:
    """short_trend of each mint's last `seconds`."""
    newest = tape.groupBy("mint").agg(F.max("t").alias("_end"))
    return short_trend(tape.join(newest, "mint").where(F.col("t") >= F.col("_end") - seconds).drop("_end"), low, high, ends, least)
