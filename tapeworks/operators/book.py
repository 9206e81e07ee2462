"""Order-book queries over levels (pair, side, price, amount); buying takes asks from the lowest price, selling bids from the highest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(book: DataFrame) -> tuple[DataFrame, Window]:
    best = F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))
    return book.withColumn("_best", best), Window.partitionBy("pair", "side").orderBy("_best")


def depth(book: DataFrame, levels: int) -> DataFrame:
    rows, w = _ranked(book)
    return rows.withColumn("level", F.row_number().over(w)).where(F.col("level") <= levels).drop("_best")


def walk(book: DataFrame, volume: float, quote: bool = False) -> DataFrame:
    """Price reached, average price and volume taken for a base (or quote) volume; enough tells if the side holds it."""
    rows, w = _ranked(book)
    size = F.col("price") * F.col("amount") if quote else F.col("amount")
    rows = rows.withColumn("_size", size).withColumn("_cum", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    take = F.greatest(F.least("_size", volume - (F.col("_cum") - F.col("_size"))), F.lit(0.0))
    base = F.col("_take") / F.col("price") if quote else F.col("_take")
    rows = rows.withColumn("_take", take)
    return rows.groupBy("pair", "side").agg(
        F.min_by("price", F.when(F.col("_cum") >= volume, F.col("_cum"))).alias("price"), F.try_divide(F.sum(base * F.col("price")), F.sum(base)).alias("vwap"), F.sum("_take").alias("taken"), (F.max("_cum") >= volume).alias("enough")
    )


def volume_for_price(book: DataFrame, price: Column) -> DataFrame:
    """Amount and quote volume at the price or better."""
    good = F.when(F.col("side") == "ask", F.col("price") <= price).otherwise(F.col("price") >= price)
    return book.groupBy("pair", "side").agg(F.sum(F.when(good, F.col("amount")).otherwise(0.0)).alias("volume"), F.sum(F.when(good, F.col("amount") * F.col("price")).otherwise(0.0)).alias("quote_volume"))


def summary(book: DataFrame) -> DataFrame:
    """Best prices, levels of both sides, the spread, and whether the sides cross."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    s = book.groupBy("pair").agg(F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"), F.count_if(bid).alias("bids"), F.count_if(ask).alias("asks"))
    return s.withColumns({"spread": F.col("best_ask") - F.col("best_bid"), "crossed": F.col("best_bid") >= F.col("best_ask")})
