"""Profit and loss of trades, positions and liquidity positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import along, scan, slices


def running(trades: DataFrame, keys: list[str], order: list[str], slice_: Column, keep: bool = False) -> DataFrame:
    """Running volumes, average prices, realised and unrealised result after each trade.

    Average cost; while nothing was bought the realised part is 0. The mark is the trade's own price; net_pnl takes off
    the trade's fee, net_pnl_all_fees all fees so far. slice_ cuts a key's order into parts that fit a task (see scans.scan, keep too).
    """
    sums = {}
    for side in ("BUY", "SELL"):
        own = F.col("side") == side
        name = side.lower()
        sums |= {f"{name}_volume": F.when(own, F.col("amount")).otherwise(0.0), f"{name}_quote": F.when(own, F.col("price") * F.col("amount")).otherwise(0.0)}
    sums |= {"cum_fee": F.col("fee"), "cum_volume": F.col("price") * F.col("amount")}
    return _results(scan(trades, keys, order, slice_, sums, keep=keep))


def _results(cols: DataFrame) -> DataFrame:
    """Average prices and results from volumes, quote volumes, the mark `price`, `fee` and `cum_fee`."""
    buy, sell = (F.coalesce(F.try_divide(F.col(f"{s}_quote"), F.col(f"{s}_volume")), F.lit(0.0)) for s in ("buy", "sell"))
    cols = cols.withColumn("buy_avg", buy).withColumn("sell_avg", sell)
    net, matched = F.col("buy_volume") - F.col("sell_volume"), F.least("buy_volume", "sell_volume")
    realized = F.when(F.col("buy_avg") == 0, 0.0).otherwise((F.col("sell_avg") - F.col("buy_avg")) * matched)
    open_ = F.when(net > 0, (F.col("price") - F.col("buy_avg")) * net).when(net < 0, (F.col("sell_avg") - F.col("price")) * -net).otherwise(0.0)
    cols = cols.withColumn("net_position", net).withColumn("realized", realized).withColumn("unrealized", open_)
    pnl = F.col("realized") + F.col("unrealized")
    return cols.withColumn("net_pnl", pnl - F.col("fee")).withColumn("net_pnl_all_fees", pnl - F.col("cum_fee"))


def summary(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """running() after each key's last trade, by one combining aggregate: the sums don't need the trades' order."""
    at = F.struct(*order)
    sums = [F.sum(F.when(F.col("side") == s, x).otherwise(0.0)).alias(f"{s.lower()}_{n}") for s in ("BUY", "SELL") for n, x in (("volume", F.col("amount")), ("quote", F.col("price") * F.col("amount")))]
    rows = trades.groupBy(*keys).agg(*sums, F.sum("fee").alias("cum_fee"), F.sum(F.col("price") * F.col("amount")).alias("cum_volume"), F.max_by("price", at).alias("price"), F.max_by("fee", at).alias("fee"))
    return _results(rows)


def positions(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by side, net, matched and realised result by average cost."""
    sums = [F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0.0)).alias(f"{s.lower()}_{n}") for s in ("BUY", "SELL") for c, n in (("amount", "base"), ("quote", "quote"))]
    rows = trades.groupBy(*keys).agg(*sums)
    avg = lambda s: F.try_divide(F.col(f"{s}_quote"), F.col(f"{s}_base"))
    net = F.col("buy_base") - F.col("sell_base")
    return rows.select(
        "*", net.alias("net_base"), avg("buy").alias("buy_price"), avg("sell").alias("sell_price"), F.least("buy_base", "sell_base").alias("matched"),
        F.when(net > 0, "LONG").when(net < 0, "SHORT").otherwise("FLAT").alias("position"),
        F.coalesce(F.least("buy_base", "sell_base") * (avg("sell") - avg("buy")), F.lit(0.0)).alias("realized"),
    )


def unrealized(mark: Column) -> Column:
    """Of a row of positions() at a price."""
    net = F.col("net_base")
    return F.when(net > 0, net * (mark - F.col("buy_price"))).when(net < 0, -net * (F.col("sell_price") - mark)).otherwise(0.0)


def drawdown(rows: DataFrame, keys: list[str], order: list[str], pnl: str, limit: float, slice_: Column) -> DataFrame:
    """Greatest fall of the running result from its peak (at least 0), and whether it passed the limit.

    The peak lies in the fall's own slice or before it, so slices give their greatest fall, highest and lowest result. Rows that
    running() made with `keep` are not dealt again.
    """
    cut = rows if "_slice" in rows.columns else slices(rows, keys, slice_)
    high = F.greatest(F.col(pnl), F.lit(0.0))
    so_far = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = cut.withColumn("_fall", F.max(high).over(so_far) - F.col(pnl)).groupBy("_slice").agg(F.max("_fall").alias("_fall"), F.max(high).alias("_high"), F.min(pnl).alias("_low"))
    peak = F.max("_high").over(along(keys).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_fall", F.greatest("_fall", peak - F.col("_low")))
    of = [F.col("_slice")[f"k{i}"].alias(k) for i, k in enumerate(keys)]
    return ends.groupBy(*of).agg(F.max("_fall").alias("max_drawdown")).withColumn("tripped", F.col("max_drawdown") > limit)


def global_drawdown(rows: DataFrame, keys: list[str], order: list[str], pnl: str, limit: float, slice_: Column, ts: str = "ts") -> DataFrame:
    """One row: the same for the sum of all keys' newest results, and when it first passed the limit (null if never).

    order must be complete over all rows. Every row changes the sum by its key's result less the one before, so the sum is a scan without a key.
    The steps are dealt by slice once; a slice's sum and highest partial sum say where the next ones start.
    """
    cut = rows if "_slice" in rows.columns else slices(rows, keys, slice_)
    inside = Window.partitionBy("_slice").orderBy(*order)
    steps = cut.select(*order, "_slice", F.col(pnl).alias("_now"), F.lag(pnl).over(inside).alias("_was"), F.row_number().over(inside).alias("_n"), F.lead(F.lit(1)).over(inside).isNull().alias("_end"))
    # a slice's first row follows the last one of its key's slice before
    lasts = steps.where("_end").select("_slice", F.lag("_now").over(along(keys)).alias("_before"))
    steps = steps.join(lasts, "_slice", "left")
    step = F.col("_now") - F.coalesce(F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_was")), F.lit(0.0))
    total = slices(steps.select(*order, F.coalesce(step, F.lit(0.0)).alias("_step"), F.col("_slice.of").alias("_of")), [], F.col("_of"))
    so_far = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = total.withColumn("_sum", F.sum("_step").over(so_far))
    total = total.withColumn("_top", F.max("_sum").over(so_far))
    parts = total.groupBy("_slice").agg(F.sum("_step").alias("_all"), F.max("_sum").alias("_high"))
    earlier = along([]).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_all").over(earlier), F.lit(0.0)))
    parts = parts.select("_slice", "_start", F.greatest(F.lit(0.0), F.max(F.col("_start") + F.col("_high")).over(earlier)).alias("_peak"))
    fall = total.join(parts, "_slice").withColumn("_fall", F.greatest(F.col("_peak"), F.col("_start") + F.col("_top")) - F.col("_start") - F.col("_sum"))
    return fall.agg(F.max("_fall").alias("max_drawdown"), F.min(F.when(F.col("_fall") > limit, F.col(ts))).alias("tripped_at")).withColumn("tripped", F.col("tripped_at").isNotNull())


def lp_result(p: DataFrame, now: Column) -> DataFrame:
    """Result of liquidity positions against holding; null unless both prices are positive."""
    ok = (F.col("entry_price") > 0) & (F.col("current_price") > 0)
    first = F.col("base0") * F.col("entry_price") + F.col("quote0")
    held = F.col("base0") * F.col("current_price") + F.col("quote0")
    lp, fees = F.col("base1") * F.col("current_price") + F.col("quote1"), F.col("base_fee") * F.col("current_price") + F.col("quote_fee")
    days = (now - F.col("opened")) / 86400
    pct = F.try_divide(lp + fees - first, first) * 100
    cols = {"initial_value": first, "lp_value": lp, "fees_value": fees, "hodl_value": held, "impermanent_loss": lp - held, "pnl": lp + fees - first, "pnl_pct": pct, "fee_apr": F.try_divide(F.try_divide(fees, first) * 365.25 * 100, days)}
    return p.withColumns({k: F.when(ok, v) for k, v in cols.items()})


def in_range(price: Column, low: Column, high: Column) -> Column:
    return F.when((price <= 0) | (low <= 0) | (high <= 0) | price.isNull() | low.isNull() | high.isNull(), "UNKNOWN").when(price.between(low, high), "IN_RANGE").otherwise("OUT_OF_RANGE")
