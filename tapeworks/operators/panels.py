"""Feature panels of a tape's first or last stretch: one row a mint, by plain aggregates that combine before the shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tape as tapes


def latest(tape: DataFrame, seconds: float) -> DataFrame:
    """Swaps of each mint's last `seconds`, with `age` before its last swap."""
    ends = tape.groupBy("mint").agg(F.max("t").alias("_end"))
    return tape.join(ends, "mint").withColumn("age", F.col("_end") - F.col("t")).where(F.col("age") <= seconds).drop("_end")


def intensity(tape: DataFrame, seconds: float, decay: float) -> DataFrame:
    """Decayed counts of the last buys and sells, and the buys' share (0.5 if there is none)."""
    weight = F.exp(-F.col("age") / decay)
    out = latest(tape, seconds).groupBy("mint").agg(
        F.sum(F.when(F.col("is_buy") == 1, weight).otherwise(0.0)).alias("buy_intensity"), F.sum(F.when(F.col("is_buy") == 0, weight).otherwise(0.0)).alias("sell_intensity")
    )
    return out.withColumn("buy_share", F.coalesce(F.try_divide("buy_intensity", F.col("buy_intensity") + F.col("sell_intensity")), F.lit(0.5)))


def label_drawdown(tape: DataFrame, delay: float, anchor: float, window: float, limit: float, least: int = 3) -> DataFrame:
    """Whether the price falls by `limit` within `window` after the entry (`delay` after the first swap).

    Measured from the median price of the first `anchor` seconds, or the first price if those hold fewer than
    `least` swaps; null with fewer than `least` swaps in the window. Prices that aren't positive don't count.
    """
    starts = tape.groupBy("mint").agg((F.min("t") + delay).alias("_entry"))
    rows = tape.where("price > 0").join(starts, "mint").withColumn("_at", F.col("t") - F.col("_entry")).where("_at >= 0")
    near, inside = F.col("_at") <= anchor, F.col("_at") <= window
    out = rows.groupBy("mint").agg(
        F.count_if(near).alias("_near"), F.median(F.when(near, F.col("price"))).alias("_median"), F.min_by("price", tapes.at(rows)).alias("_first"),
        F.count_if(inside).alias("swaps"), F.min(F.when(inside, F.col("price"))).alias("_low"),
    )
    fall = F.try_divide("_low", F.when(F.col("_near") >= least, F.col("_median")).otherwise(F.col("_first"))) - 1
    return out.select("mint", "swaps", F.when(F.col("swaps") >= least, fall).alias("drawdown")).withColumn("label", (F.col("drawdown") <= limit).cast("int"))


def opening(tape: DataFrame, starts: DataFrame, seconds: float, dust: float) -> DataFrame:
    """Swaps of at least `dust` volume in the closed first `seconds` after each mint's start (mint, g), with `age` since it."""
    rows = tape.join(starts.select("mint", "g"), "mint").withColumn("age", F.col("t") - F.col("g"))
    return rows.where((F.col("age") >= 0) & (F.col("age") <= seconds) & (F.col("volume") >= dust))


def _valid(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("price") > 0) & ~F.isnan("price") & (F.col("price") < float("inf")))


def shares(rows: DataFrame, top: int) -> DataFrame:
    """Of each mint's buyers: sum of squared shares of the volume, of the `top` largest ones too, and the largest ones' share."""
    w = Window.partitionBy("mint")
    own = rows.where("is_buy = 1").groupBy("mint", "trader").agg(F.sum("volume").alias("_v"))
    own = own.withColumns({"_s": F.try_divide("_v", F.sum("_v").over(w)), "_r": F.row_number().over(w.orderBy(F.desc("_v"), "trader"))})
    largest = F.when(F.col("_r") <= top, F.col("_s"))
    return own.groupBy("mint").agg(F.sum(F.col("_s") * F.col("_s")).alias("hhi"), F.sum(largest * largest).alias("hhi_top"), F.sum(largest).alias("top_share"), F.max("_s").alias("top1"))


def panel5(tape: DataFrame, starts: DataFrame, unit: float = 1.0, dust: float = 0.05, least: int = 5) -> DataFrame:
    """Peak result, recoveries, concentration of the first buyers, sold share and variation of sizes in the first 300 units.

    Mints with fewer than `least` swaps or valid prices, or a reference price near 0, are left out. The reference is the median
    of the first five prices; the peak result is capped at 100.
    """
    rows = opening(tape, starts, 300 * unit, dust)
    ok = _valid(rows)
    at = tapes.by_time(ok)
    first = ok.withColumn("_k", F.row_number().over(at)).groupBy("mint").agg(
        F.count("*").alias("_valid"), F.median(F.when(F.col("_k") <= 5, F.col("price"))).alias("_ref"), F.max("price").alias("_peak")
    )
    totals = rows.groupBy("mint").agg(
        F.count("*").alias("_n"), F.coalesce(F.try_divide(F.sum(F.when(F.col("is_buy") == 0, F.col("volume")).otherwise(0.0)), F.sum("volume")), F.lit(0.0)).alias("sell_share"),
        F.coalesce(F.try_divide(F.stddev_pop("volume"), F.avg("volume")), F.lit(0.0)).alias("size_cv"),
    )
    early = shares(rows.where(F.col("age") <= 60 * unit), 5).select("mint", (F.col("hhi_top") / 0.2).alias("hhi_top5"))
    out = totals.where(F.col("_n") >= least).join(first.where((F.col("_valid") >= 5) & (F.col("_ref") >= 1e-9)), "mint").join(tapes.new_highs(ok), "mint").join(early, "mint", "left")
    peak = F.least((F.col("_peak") - F.col("_ref")) / F.col("_ref"), F.lit(100.0))
    return out.select("mint", peak.alias("peak_pnl"), F.col("new_highs").alias("recoveries"), F.coalesce("hhi_top5", F.lit(0.0)).alias("hhi_top5"), "sell_share", "size_cv", F.col("_n").alias("swaps"))


def pre_event_volatility(closes: DataFrame, starts: DataFrame, seconds: int, steps: int = 12, least: int = 6) -> DataFrame:
    """(mint, volatility): deviation of the last `steps` returns of a price series (bucket, close) before each start.

    Buckets are epoch seconds floored to `seconds`; each return needs both of its buckets, and `least` of them are needed.
    """
    bucket = F.floor((F.col("g") - F.col("k") * seconds) / seconds) * seconds
    wanted = starts.select("mint", "g", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")).withColumn("bucket", bucket.cast("long"))
    rows = wanted.join(closes.where("close > 0"), "bucket", "left")
    rows = rows.withColumn("_before", F.lead("close").over(Window.partitionBy("mint").orderBy("k"))).withColumn("_r", (F.col("close") - F.col("_before")) / F.col("_before")).where(F.col("k") < steps)
    return rows.groupBy("mint").agg(F.when(F.count("_r") >= least, F.stddev_pop("_r")).alias("volatility"))


def panel22(tape: DataFrame, starts: DataFrame, unit: float = 1.0, dust: float = 0.05, least: int = 10) -> DataFrame:
    """Counts, sizes, shares, concentration, confirmed prices and microstructure of the first 300 units after each start.

    Holds the columns of both larger panels. Mints with fewer than `least` swaps or five valid prices are left out; single values
    that need more are null. Windows hold a mint's swaps of the 300 units.
    """
    rows = opening(tape, starts, 300 * unit, dust)
    early, at = F.col("age") <= 60 * unit, tapes.by_time(rows)
    buy = F.sum(F.when(F.col("is_buy") == 1, F.col("volume")).otherwise(0.0))
    sell = F.sum(F.when(F.col("is_buy") == 0, F.col("volume")).otherwise(0.0))
    n60, n300 = F.count_if(early), F.count("*")
    traders60 = F.count_distinct(F.when(early, F.col("trader")))
    totals = rows.groupBy("mint").agg(
        n60.cast("double").alias("swap_count_60"), n300.cast("double").alias("swap_count_300"), (n60 / 60 / (n300 / 300)).alias("density_ratio"), F.avg(F.when(early, F.col("volume"))).alias("mean_size_60"),
        F.avg("volume").alias("mean_size_300"), F.percentile("volume", 0.95).alias("p95_size"), F.sum("volume").alias("total_volume"), F.count_distinct("trader").cast("double").alias("unique_traders"),
        F.try_divide(F.count_distinct("trader") - traders60, traders60).alias("new_trader_rate"), (F.count_if(F.col("is_buy") == 1) / n300).alias("buy_count_share"), (F.count_if(F.col("is_buy") == 0) / n300).alias("sell_count_share"),
        F.try_divide(buy - sell, buy + sell).alias("ofi"), F.try_divide(F.max("volume"), F.sum("volume")).alias("top1_swap_share"), F.floor(F.max("g") % 86400 / 3600).cast("double").alias("start_hour"),
    )
    ok = _valid(rows)
    returns = ok.withColumn("_r", F.ln("price") - F.ln(F.lag("price").over(at))).withColumn("_q", F.lag("_r").over(at))
    enough, cov = F.count("*") >= 10, F.covar_samp("_r", "_q")
    prices = returns.groupBy("mint").agg(
        F.count("*").alias("_valid"), (F.max_by("price", tapes.at(ok)) / F.max("price") - 1).alias("drawdown"), F.when(enough, F.median(F.abs("_r") / F.greatest("volume", F.lit(0.01)))).alias("kyle_lambda"),
        F.when(enough, F.when(cov < 0, 2 * F.sqrt(-cov)).otherwise(0.0)).alias("roll_spread"),
    )
    sure = tapes.confirmed(ok, int(5 * unit)).where("confirmed")
    peaks = sure.withColumns({"_a": F.lag("price").over(at), "_b": F.lead("price").over(at)})
    two = F.count("*") >= 2
    peaks = peaks.groupBy("mint").agg(
        F.when(two, F.max_by("price", tapes.at(ok)) / F.max("price") - 1).alias("drawdown_confirmed"), F.when(two, F.count_if((F.col("price") > F.col("_a")) & (F.col("price") > F.col("_b")))).cast("double").alias("local_maxima")
    )
    buckets = rows.where(F.col("age") < 300 * unit).groupBy("mint", F.floor(F.col("age") / (30 * unit)).alias("_k")).agg(F.count("*").alias("_n"), (buy - sell).alias("_d"), F.sum("volume").alias("_v"))
    vpin = buckets.where((F.col("_n") >= 3) & (F.col("_v") > 0)).groupBy("mint").agg(F.avg(F.abs("_d") / F.col("_v")).alias("vpin"))
    runs = tapes.streaks(rows).select("mint", F.col("sell_streak").cast("double").alias("sell_streak"), F.col("switches").cast("double").alias("switches"))
    held = shares(rows, 3).select("mint", F.col("hhi").alias("buyer_hhi"), F.col("top_share").alias("buyer_top3"))
    out = totals.where(F.col("swap_count_300") >= least).join(prices.where("_valid >= 5").drop("_valid"), "mint")
    for part in (peaks, vpin, runs, held):
        out = out.join(part, "mint", "left")
    return out


#: Columns of the two larger panels; both add the volatility before the start.
PANEL18 = (
    "kyle_lambda top1_swap_share vpin unique_traders swap_count_300 roll_spread buy_count_share switches drawdown swap_count_60 new_trader_rate mean_size_300 p95_size density_ratio sell_streak mean_size_60 start_hour"
).split()
PANEL22 = (
    "swap_count_60 swap_count_300 density_ratio mean_size_60 mean_size_300 p95_size total_volume unique_traders buyer_hhi buyer_top3 local_maxima buy_count_share sell_count_share ofi drawdown_confirmed vpin top1_swap_share "
    "switches sell_streak new_trader_rate start_hour"
).split()


def time_of_window(now: Column, start: Column, seconds: float) -> dict[str, Column]:
    """Age since the start as a share of `seconds` within 0 and 1, and its phase."""
    age = F.greatest(F.least((now - start) / seconds, F.lit(1.0)), F.lit(0.0))
    return {"age_norm": age, "phase_sin": F.sin(2 * math.pi * age), "phase_cos": F.cos(2 * math.pi * age)}


def ticks(tape: DataFrame, seconds: float, least: int = 3) -> DataFrame:
    """Distribution of sizes and gaps of each mint's last `seconds`; zeros for fewer than `least` swaps.

    The skewness is that of the population, within -10 and 10; gaps of 0 don't count.
    """
    at = tapes.by_time(tape)
    rows = latest(tape, seconds).withColumn("_gap", F.col("t") - F.lag("t").over(at))
    gap = F.when(F.col("_gap") > 0, F.col("_gap"))
    skew = F.greatest(F.least(F.coalesce(F.nanvl(F.skewness("volume"), F.lit(0.0)), F.lit(0.0)), F.lit(10.0)), F.lit(-10.0))
    out = rows.groupBy("mint").agg(
        F.count("*").alias("_n"), F.percentile("volume", 0.9).alias("size_p90"), skew.alias("size_skew"), F.coalesce(F.percentile(gap, 0.1), F.lit(0.0)).alias("gap_p10"),
        F.coalesce(F.percentile(gap, 0.9), F.lit(0.0)).alias("gap_p90"), F.count_distinct("trader").cast("double").alias("traders"),
    )
    return out.select("mint", *[F.when(F.col("_n") >= least, F.col(c)).otherwise(0.0).alias(c) for c in ("size_p90", "size_skew", "gap_p10", "gap_p90", "traders")])


def flow_micro(tape: DataFrame, starts: DataFrame, seconds: int, late: float, span: int, least: int = 5) -> DataFrame:
    """Buyers, their concentration, late imbalance, growth and sellers per buyer in the half open first `seconds`.

    Growth: new buyers of the later half of the periods (as many as `span` fits, two at least) over those of the earlier half.
    """
    rows = tape.join(starts.select("mint", "g"), "mint").withColumn("age", F.col("t") - F.col("g")).where((F.col("age") >= 0) & (F.col("age") < seconds))
    size = seconds // max(2, seconds // span)
    periods = -(-seconds // size)
    buyers = rows.where("is_buy = 1").groupBy("mint", "trader").agg(F.sum("volume").alias("_v"), F.min(F.floor(F.col("age") / size)).alias("_k"))
    w = Window.partitionBy("mint")
    buyers = buyers.withColumn("_s", F.try_divide("_v", F.sum("_v").over(w))).groupBy("mint").agg(
        F.sum(F.col("_s") * F.col("_s")).alias("_hhi"), F.max("_s").alias("_top1"), F.count_if(F.col("_k") < periods // 2).alias("_early"), F.count_if(F.col("_k") >= periods // 2).alias("_late")
    )
    side = F.when(F.col("is_buy") == 1, F.col("volume")).otherwise(-F.col("volume"))
    tail = F.col("age") >= max(0, seconds - late)
    one = lambda b: F.count_distinct(F.when(F.col("is_buy") == b, F.col("trader")))
    out = rows.groupBy("mint").agg(F.count("*").alias("_n"), one(1).alias("buyers"), one(0).alias("_sellers"), F.coalesce(F.try_divide(F.sum(F.when(tail, side)), F.sum(F.when(tail, F.col("volume")))), F.lit(0.0)).alias("late_imbalance"))
    return out.where(F.col("_n") >= least).join(buyers, "mint", "left").select(
        "mint", "buyers", F.coalesce("_hhi", F.lit(1.0)).alias("buyer_hhi"), F.coalesce("_top1", F.lit(1.0)).alias("top1_share"), "late_imbalance",
        (F.coalesce("_late", F.lit(0)) / F.greatest(F.coalesce("_early", F.lit(0)), F.lit(1))).alias("growth"), (F.col("_sellers") / F.greatest("buyers", F.lit(1))).alias("sellers_per_buyer"),
    )


def hawkes(tape: DataFrame, seconds: float, decay: float, after: float) -> DataFrame:
    """Decayed counts of each side's last `seconds`, and the mean number of swaps that follow one of their side within `after`, of the last `after`."""
    near = latest(tape, after)
    follow = tapes.branching(near, after).withColumnRenamed("successors", "_f").groupBy("mint").agg(
        *[F.when(F.count_if(F.col("is_buy") == b) > 1, F.avg(F.when(F.col("is_buy") == b, F.col("_f")))).alias(n) for b, n in ((1, "branching_buy"), (0, "branching_sell"))]
    )
    return intensity(tape, seconds, decay).join(follow, "mint", "left").fillna(0.0, ["branching_buy", "branching_sell"])
