"""Bars of a fixed number from each mint's start, with layers against dust and outliers; weighted median prices of the newest swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tape as tapes


def aligned(tape: DataFrame, starts: DataFrame, seconds: int, count: int) -> DataFrame:
    """(mint, start, shifted): a start without swaps in its `count` bars moves to the bar of the mint's first swap."""
    inside = (F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + seconds * count)
    found = tape.join(starts, "mint").groupBy("mint").agg(F.max("start").alias("start"), F.min("t").alias("_first"), F.count_if(inside).alias("_n"))
    shifted = F.col("_n") == 0
    return found.select("mint", F.when(shifted, F.floor(F.col("_first") / seconds) * seconds).otherwise(F.col("start")).cast("long").alias("start"), shifted.alias("shifted"))


def without_dust(rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Rows of at least this volume; all rows of a key that has none."""
    large = F.col("volume") >= least
    return rows.withColumn("_n", F.count_if(large).over(Window.partitionBy(*keys))).where(large | (F.col("_n") == 0)).drop("_n")


def without_outliers(rows: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Rows whose log price is within `most` of the median, weighted by the root of the volume; keys of up to two rows keep all.

    Prices that aren't positive don't count and go, unless a key has no others.
    """
    w = Window.partitionBy(*keys)
    ok = F.col("price") > 0
    rows = rows.withColumns({"_lp": F.when(ok, F.ln("price")), "_w": F.when(ok, F.sqrt(F.greatest("volume", F.lit(1e-9))))})
    rows = rows.withColumns({
        "_c": F.sum("_w").over(w.orderBy(F.asc_nulls_last("_lp"), "_w").rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("_w").over(w), "_n": F.count("*").over(w)
    })
    middle = F.min(F.when(F.col("_c") >= F.col("_total") / 2, F.col("_lp"))).over(w)
    keep = (F.col("_n") <= 2) | F.col("_total").isNull() | (F.abs(F.col("_lp") - middle) <= most)
    return rows.withColumn("_keep", keep).where("_keep").drop("_lp", "_w", "_c", "_total", "_n", "_keep")


def clean_bars(tape: DataFrame, starts: DataFrame, seconds: int, count: int, dust: float, outlier: float, tail: float, strict: bool = True) -> DataFrame:
    """(mint, bar, bar_start, open, high, low, close, volume, trades, buys, sells, shifted): `count` bars of each mint.

    Bars are half open. Of each, small swaps go unless there are no others, then outliers. The close is the average of the
    last `tail` seconds weighted by volume, or the last price; empty bars repeat the close before them. A mint whose
    first bar is empty has no bars; without `strict`, those from the first one with swaps on. The windows hold
    the swaps of one bar.
    """
    spans = aligned(tape, starts, seconds, count)
    rows = tape.join(spans, "mint").withColumn("bar", F.floor((F.col("t") - F.col("start")) / seconds)).where(F.col("bar").between(0, count - 1))
    rows = without_outliers(without_dust(rows, ["mint", "bar"], dust), ["mint", "bar"], outlier)
    late = F.col("t") >= F.col("start") + (F.col("bar") + 1) * seconds - tail
    own = rows.groupBy("mint", "bar").agg(
        F.min_by("price", tapes.at(rows)).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.coalesce(F.try_divide(F.sum(F.when(late, F.col("price") * F.col("volume"))), F.sum(F.when(late, F.col("volume")))), F.max_by("price", tapes.at(rows))).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("trades"), F.count_if(F.col("is_buy") == 1).alias("buys"), F.count_if(F.col("is_buy") == 0).alias("sells"),
    )
    grid = spans.select("mint", "start", "shifted", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("bar"))
    so_far = Window.partitionBy("mint").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(own, ["mint", "bar"], "left").withColumn("close", F.last("close", ignorenulls=True).over(so_far))
    if strict:
        out = out.withColumn("_first", F.first("close").over(so_far)).where(F.col("_first").isNotNull())
    out = out.where(F.col("close").isNotNull())
    flat = {c: F.coalesce(c, "close") for c in ("open", "high", "low")} | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("volume", "trades", "buys", "sells")}
    return out.withColumns(flat).select("mint", "bar", (F.col("start") + F.col("bar") * seconds).alias("bar_start"), "open", "high", "low", "close", "volume", "trades", "buys", "sells", "shifted")


def median_price(tape: DataFrame, now: Column, seconds: float, gate: float, least: int) -> DataFrame:
    """Per mint the price at half of the volume of its newest swaps, with what it rests on and a status.

    Swaps count if they are at most `seconds` old at `now`, of `gate` volume or more, with positive price and volume. The sums
    by mint come from a combining aggregate; equal prices are added up before the running sum, so a mint's window has
    a row for each different price.
    """
    age = now - F.col("t")
    good = (age <= seconds) & (F.col("volume") >= gate) & (F.col("volume") > 0) & (F.col("price") > 0)
    total = tape.groupBy("mint").agg(
        F.count("*").alias("buffer"), F.count_if(good).alias("qualified"), F.max(F.when(good, age)).alias("oldest_age"), F.min(F.when(good, age)).alias("newest_age"),
        F.sum(F.when(good, F.col("volume"))).alias("volume"), F.min(F.when(good, F.col("price"))).alias("price_min"), F.max(F.when(good, F.col("price"))).alias("price_max"),
    )
    levels = tape.where(good).groupBy("mint", "price").agg(F.sum("volume").alias("_v"))
    w = Window.partitionBy("mint").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    half = levels.withColumn("_c", F.sum("_v").over(w)).join(total.select("mint", F.col("volume").alias("_t")), "mint").where(F.col("_c") >= F.col("_t") / 2)
    price = half.groupBy("mint").agg(F.min("price").alias("_p"))
    status = F.when(F.col("qualified") == 0, "no_data").when(F.col("qualified") < least, "insufficient_swaps").otherwise("ok")
    return total.join(price, "mint", "left").withColumns({"price": F.when(F.col("qualified") >= least, F.col("_p")), "status": status}).drop("_p")


def recent(tape: DataFrame, seconds: float) -> DataFrame:
    """Swaps at most `seconds` older than their mint's newest, whatever order they come in."""
    newest = tape.groupBy("mint").agg(F.max("t").alias("_end"))
    return tape.join(newest, "mint").where(F.col("t") >= F.col("_end") - seconds).drop("_end")


def level_confirmed(tape: DataFrame, level: Column, seconds: float, traders: int, above: bool) -> DataFrame:
    """Whether so many different traders swapped at the level or beyond it in a mint's last `seconds`."""
    beyond = F.col("price") >= level if above else F.col("price") <= level
    return recent(tape, seconds).groupBy("mint").agg(F.count_distinct(F.when(beyond, F.col("trader"))).alias("traders")).withColumn("confirmed", F.col("traders") >= traders)
