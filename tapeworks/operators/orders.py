"""Orders as their events leave them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(events: DataFrame, order: Column) -> DataFrame:
    """(order_id, amount, fills, filled, last_price, fee, status) of events (order_id, kind, ts, amount, price, fee, ..).

    Kinds are created, filled, cancelled and failed. Fills before the creation don't count, orders that were never created give
    no row. An end that comes after the last fill decides the status (failed before cancelled); else the fills do.
    Two combining aggregates, no state machine: the result doesn't depend on how the events arrive.
    """
    kind = F.col("kind")
    born = events.where(kind == "created").groupBy("order_id").agg(F.min("ts").alias("_born"), F.max("amount").alias("_amount"))
    fill = (kind == "filled") & (F.col("ts") >= F.col("_born"))
    rows = events.join(born, "order_id").groupBy("order_id").agg(
        F.max("_amount").alias("amount"), F.count_if(fill).alias("fills"), F.coalesce(F.sum(F.when(fill, F.col("amount"))), F.lit(0.0)).alias("filled"), F.max_by("price", F.when(fill, order)).alias("last_price"),
        F.coalesce(F.sum(F.when(fill, F.col("fee"))), F.lit(0.0)).alias("fee"), F.max(F.when(fill, F.col("ts"))).alias("_last"), F.max(F.when(kind == "cancelled", F.col("ts"))).alias("_cancelled"), F.max(F.when(kind == "failed", F.col("ts"))).alias("_failed"),
    )
    after = lambda c: F.col(c).isNotNull() & (F.col("_last").isNull() | (F.col("_last") < F.col(c)))
    status = F.when(after("_failed"), "FAILED").when(after("_cancelled"), "CANCELLED").when(F.col("filled") >= F.col("amount"), "FILLED").when(F.col("fills") > 0, "PARTIALLY_FILLED").otherwise("OPEN")
    return rows.withColumn("status", status).drop("_last", "_cancelled", "_failed")
