"""Swaps from the changes of balances that transactions leave behind.

Legs are rows (tx, account, mint, owner, pre, post): an account's token balance before and after; a missing side is null and counts as 0.
Natives are rows (tx, account, pre, post) in the smallest unit. Transactions are rows (tx, base, signer, failed, t).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Changes of a token below this are none; native changes up to this many units are fees and dust.
NOTHING, DUST, UNITS = 1e-12, 100_000, 1e9


def net_changes(legs: DataFrame) -> DataFrame:
    """(tx, mint, owner, delta): an owner's change of a token over all of its accounts."""
    change = F.coalesce("post", F.lit(0.0)) - F.coalesce("pre", F.lit(0.0))
    rows = legs.withColumn("_d", change).where(F.abs("_d") >= NOTHING)
    return rows.groupBy("tx", "mint", "owner").agg(F.sum("_d").alias("delta"))


def swaps(transactions: DataFrame, legs: DataFrame, natives: DataFrame, quote: str) -> DataFrame:
    """(tx, mint, trader, is_buy, base_amount, quote_amount, price, t) of the transactions that are swaps of their base token.

    The amount of base is the signer's change; a signer without one stands for the owner with the largest change against the others' sum, the
    pool's counterpart. The quote amount is the larger of what was paid or received in the quote token, and of the same in native units without
    dust. The sign gate: the trader's change of the quote token, if there is one beyond the fee (a hundredth of the amount), must go the other
    way than that of base. Failed transactions, those without time, base or quote amount, and gated ones give no row.
    """
    changes = net_changes(legs).join(transactions.where(~F.coalesce("failed", F.lit(False)) & F.col("t").isNotNull()), "tx")
    base, paid = F.col("mint") == F.col("base"), F.col("mint") == quote
    own = F.col("owner") == F.col("signer")
    up = lambda c: F.sum(F.when(c & (F.col("delta") > 0), F.col("delta")).otherwise(0.0))
    down = lambda c: F.sum(F.when(c & (F.col("delta") < 0), -F.col("delta")).otherwise(0.0))
    largest = F.struct(F.abs("delta").alias("size"), F.col("owner"), F.col("delta"))
    tokens = changes.groupBy("tx").agg(
        F.first("base").alias("mint"), F.first("signer").alias("signer"), F.first("t").alias("t"), F.sum(F.when(base & own, F.col("delta"))).alias("_signed"), F.max(F.when(base, largest)).alias("_top"),
        F.greatest(up(paid), down(paid)).alias("_token"), F.sum(F.when(paid & own, F.col("delta"))).alias("_paid"),
    )
    move = F.col("post") - F.col("pre")
    coins = natives.groupBy("tx").agg(F.greatest(F.sum(F.when(move > DUST, move).otherwise(0)), F.sum(F.when(move < -DUST, -move).otherwise(0))).alias("_coins"))
    rows = tokens.join(coins, "tx", "left").withColumn("quote_amount", F.greatest("_token", F.coalesce(F.col("_coins") / UNITS, F.lit(0.0))))
    signed = F.col("_signed").isNotNull() & (F.abs("_signed") >= NOTHING)
    # the largest change of another owner is the pool's: the trader's is its opposite
    rows = rows.withColumn("_delta", F.when(signed, F.col("_signed")).otherwise(-F.col("_top.delta")))
    agree = F.col("_paid").isNull() | (F.abs("_paid") <= 0.01 * F.col("quote_amount")) | (F.signum("_paid") != F.signum("_delta"))
    rows = rows.where((F.abs("_delta") >= NOTHING) & (F.col("quote_amount") > 0) & agree)
    return rows.select("tx", "mint", F.col("signer").alias("trader"), (F.col("_delta") > 0).cast("int").alias("is_buy"), F.abs("_delta").alias("base_amount"), "quote_amount", F.try_divide(F.col("quote_amount"), F.abs("_delta")).alias("price"), "t")
