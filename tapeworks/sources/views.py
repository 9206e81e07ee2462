"""Domain views over the driver's tables: orders, trades, token states, swaps, order book, executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Complete order of the trades of one pair and connector.
TRADE_ORDER = ["ts", "order_id", "line", "part", "supp", "quote"]


def epoch(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, as a double, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})") / F.lit(1e6)


def month(ts: str) -> Column:
    """Months since 1970: a slice of a key's history."""
    return F.year(ts) * 12 + F.month(ts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("PARTIALLY_FILLED")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("client_order_id"), F.col("c_mktsegment").alias("account"), F.col("c_nationkey").alias("nation"), status.alias("status"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("kind"),
    )


ORDERS = """orders_v as (select o_orderkey client_order_id, c_mktsegment account, c_nationkey nation,
  case o_orderstatus when 'F' then 'FILLED' when 'O' then 'OPEN' else 'PARTIALLY_FILLED' end status,
  o_totalprice amount, o_orderdate created_at, o_orderpriority kind from orders join customer on o_custkey = c_custkey)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey") % 20).alias("pair"), F.concat(F.lit("C"), F.col("l_suppkey") % 5).alias("connector"),
        F.when(F.col("l_returnflag").isin("A", "N"), "BUY").otherwise("SELL").alias("side"), F.col("l_quantity").alias("amount"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("quote"), (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("fee"),
        F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
    )


TRADES = """trades_v as (select 'P' || (l_partkey % 20) pair, 'C' || (l_suppkey % 5) connector, case when l_returnflag in ('A', 'N') then 'BUY' else 'SELL' end side,
  l_quantity amount, l_extendedprice / l_quantity price, l_extendedprice quote, l_extendedprice * l_tax / 100 fee, l_shipdate ts,
  l_orderkey order_id, l_linenumber line, l_partkey part, l_suppkey supp from lineitem)"""
TRADE_BY = "ts, order_id, line, part, supp, quote"


def token_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots: one a day for each account and connector, a row for each token."""
    o = orders(spark, sf_dir).withColumn("connector", F.concat(F.lit("N"), F.col("nation") % 3))
    return o.groupBy(F.col("created_at").alias("ts"), "account", "connector", F.col("kind").alias("token")).agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("value"), F.count("*").cast("double").alias("units")
    )


STATES = ORDERS + """, states_v as (select created_at ts, account, 'N' || (nation % 3) connector, kind token,
  sum(amount::decimal(18,2))::double as value, count(*)::double units from orders_v group by all)"""


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape with `seq`, which orders swaps of one time."""
    return swaps_of(table(spark, sf_dir, "events"), F.col("event_id").alias("seq"))


def swaps_of(events: DataFrame, *more: Column) -> DataFrame:
    """Swaps of a table or stream of events, with `more` of its columns."""
    return events.select(
        (F.col("user_id") % 10).alias("mint"), F.col("user_id").alias("trader"), F.col("event_type").isin("click", "view", "purchase").cast("int").alias("is_buy"),
        F.col("value").alias("volume"), (1 + (F.col("event_id") * 7919 % 1000) / 1000).alias("price"), epoch("ts").alias("t"), *more,
    )


SWAPS = """swaps_v as (select user_id % 10 mint, user_id trader, (event_type in ('click', 'view', 'purchase'))::int is_buy, value volume,
  1 + (event_id * 7919 % 1000) / 1000 price, epoch_us(ts) / 1e6 t from events)"""


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order books of the first ten pairs."""
    return book_of(table(spark, sf_dir, "lineitem").where("l_partkey % 40 < 10"))


def full_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order books of all pairs, from every line."""
    return book_of(table(spark, sf_dir, "lineitem"))


def book_of(t: DataFrame) -> DataFrame:
    """Order-book levels by pair: asks from open lines, bids from others, at rounded prices."""
    side = F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid")
    shift = F.when(F.col("l_linestatus") == "O", 2000).otherwise(0)
    return t.groupBy(F.concat(F.lit("P"), F.col("l_partkey") % 40).alias("pair"), side.alias("side"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity")) + shift).cast("double").alias("price")).agg(
        F.sum("l_quantity").alias("amount")
    )


BOOK = """book_v as (select 'P' || (l_partkey % 40) pair, case l_linestatus when 'O' then 'ask' else 'bid' end side,
  (floor(l_extendedprice / l_quantity) + case l_linestatus when 'O' then 2000 else 0 end)::double price, sum(l_quantity) amount from lineitem where l_partkey % 40 < 10 group by all)"""
FULL_BOOK = BOOK.replace(" where l_partkey % 40 < 10", "")


def executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select(
        F.col("client_order_id").alias("executor_id"), F.col("kind").alias("executor_type"), F.concat(F.lit("N"), F.col("nation")).alias("connector"),
        F.when(F.col("status") == "OPEN", "RUNNING").otherwise("TERMINATED").alias("status"), (F.col("amount") * (F.col("client_order_id") % 7 - 3) / 100).alias("net_pnl"), F.col("amount").alias("volume"), "created_at",
    )


EXECUTORS = ORDERS + """, executors_v as (select client_order_id executor_id, kind executor_type, 'N' || nation connector,
  case status when 'OPEN' then 'RUNNING' else 'TERMINATED' end status, amount * (client_order_id % 7 - 3) / 100 net_pnl, amount volume, created_at from orders_v)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bot runs: one of each order."""
    number = F.col("client_order_id")
    return orders(spark, sf_dir).select(
        number.alias("run_id"), F.concat(F.lit("bot_"), F.col("nation")).alias("bot"), F.col("kind").alias("strategy_type"), "account", F.col("created_at").alias("deployed_at"),
        F.when(number % 4 == 0, "ARCHIVED").otherwise("DEPLOYED").alias("deployment_status"), F.when(F.col("status") == "OPEN", "RUNNING").when(F.col("status") == "FILLED", "STOPPED").otherwise("CREATED").alias("run_status"),
    )


RUNS = ORDERS + """, runs_v as (select client_order_id run_id, 'bot_' || nation bot, kind strategy_type, account, created_at deployed_at, case when client_order_id % 4 = 0 then 'ARCHIVED' else 'DEPLOYED' end deployment_status,
  case status when 'OPEN' then 'RUNNING' when 'FILLED' then 'STOPPED' else 'CREATED' end run_status from orders_v)"""


def gateway_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swaps through a gateway: amounts in and out, gas (none for some) and status."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("net"), F.col("l_suppkey") % 3).alias("network"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("input_amount"),
        F.col("l_extendedprice").alias("output_amount"), F.when(F.col("l_linenumber") > 1, F.col("l_tax")).alias("gas_fee"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linestatus") == "F", "CONFIRMED").when(F.col("l_discount") < 0.05, "SUBMITTED").otherwise("FAILED").alias("status"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
    )


GATEWAY = """gateway_v as (select 'net' || (l_suppkey % 3) network, case l_returnflag when 'R' then 'SELL' else 'BUY' end side, l_quantity input_amount, l_extendedprice output_amount, case when l_linenumber > 1 then l_tax end gas_fee, l_shipdate ts,
  l_orderkey order_id, l_linenumber line, case when l_linestatus = 'F' then 'CONFIRMED' when l_discount < 0.05 then 'SUBMITTED' else 'FAILED' end status, l_partkey part, l_suppkey supp from lineitem)"""
