"""Queries on archives, sinks, candles, listings and topics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import history, tape
from ..sinks import tables
from ..sources import archive
from ..sources import views as v
from ..sources.shared import shared_folder
from .market import BARS, HOUR, _bars, rounded
from .registry import query


def _archived(spark, d):
    """The trades as an archive stores them: millionths, market and symbol."""
    million = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return v.trades(spark, d).select(
        F.concat(F.lit("conf_"), F.col("supp") % 3).alias("config_file_path"), F.col("connector").alias("market"), F.col("pair").alias("symbol"), F.col("side").alias("trade_type"),
        million("amount").alias("amount"), million("price").alias("price"), million("fee").alias("trade_fee_in_quote"), *v.TRADE_ORDER,
    )


ARCHIVED = v.TRADES + """, archived as (select 'conf_' || (supp % 3) config_file_path, connector connector_name, pair trading_pair, side trade_type, round(amount * 1e6)::bigint / 1e6 amount,
  round(price * 1e6)::bigint / 1e6 price, round(fee * 1e6)::bigint / 1e6 trade_fee_in_quote, ts, order_id, line, part, supp, quote from trades_v)"""


@query("archive_orders", f"with {ARCHIVED} select connector_name, trading_pair, count(*) orders, round(sum(amount), 3) amount, round(max(price), 6) top_price from archived group by all")
def archive_orders(spark, d):
    rows = archive.plain(_archived(spark, d), "orders")
    return rows.groupBy("connector_name", "trading_pair").agg(F.count("*").alias("orders"), F.round(F.sum("amount"), 3).alias("amount"), F.round(F.max("price"), 6).alias("top_price"))


FILL_KEYS = ["config_file_path", "connector_name", "trading_pair"]


@query("archive_fills", f"""with {ARCHIVED}, c as (select *, sum(trade_fee_in_quote) over (w rows unbounded preceding) cum, row_number() over w k from archived window w as (partition by config_file_path, connector_name, trading_pair order by {v.TRADE_BY})),
  f as (select *, cum - lag(cum) over (partition by config_file_path, connector_name, trading_pair order by {v.TRADE_BY}) step from c)
  select config_file_path, connector_name, trading_pair, k::bigint k, round(amount, 6) amount, round(cum, 6) cum_fees_in_quote, round(step, 6) trade_fee from f""")
def archive_fills(spark, d):
    rows = archive.with_cumulative_fees(archive.plain(_archived(spark, d), "trade_fills"), FILL_KEYS, v.TRADE_ORDER, v.month("ts"))
    return rounded(rows.select(*FILL_KEYS, "k", "amount", "cum_fees_in_quote", "trade_fee"), 6, "amount", "cum_fees_in_quote", "trade_fee")


@query("archive_positions", f"with {v.TRADES} select pair trading_pair, connector connector_name, round(round(sum(quote) * 1e6)::bigint / 1e6, 3) volume_traded_quote, round(round(sum(amount) * 1e6)::bigint / 1e6, 3) amount from trades_v group by all")
def archive_positions(spark, d):
    million = lambda c: F.round(F.sum(c) * 1e6).cast("long")
    stored = v.trades(spark, d).groupBy(F.col("pair").alias("symbol"), F.col("connector").alias("market")).agg(million("quote").alias("volume_traded_quote"), million("amount").alias("amount"))
    return rounded(archive.plain(stored, "positions"), 3, "volume_traded_quote", "amount")


RAW = ("order_status", "executors", "controllers")


@query("archive_status", " union all ".join(f"select '{n}' as source, case when count(*) > 0 then 'Correct' else 'Error - No records matched' end status from {t}" for n, t in zip(RAW, ("orders", "lineitem", "customer"))) + " union all select null, 'Correct'")
def archive_status(spark, d):
    return archive.health({n: archive.plain(v.table(spark, d, t), n) for n, t in zip(RAW, ("orders", "lineitem", "customer"))})


@query("archive_discovery", f"with {v.TRADES} select 'bot_' || (supp % 3) as instance, connector connector_name, count(*) fills, round(sum(round(amount * 1e6)::bigint / 1e6), 3) amount from trades_v group by all")
def archive_discovery(spark, d):
    """Archives of three instances are written, then found and read together."""
    root = f"{shared_folder(spark)}/tapeworks/archived-{uuid.uuid4().hex}"
    rows = _archived(spark, d).persist()
    try:
        for k in range(3):
            rows.where(F.col("supp") % 3 == k).write.parquet(f"{root}/bot_{k}/data/trade_fills.parquet")
    finally:
        rows.unpersist()
    found = archive.discover(spark, root, "trade_fills")
    return found.groupBy("instance", "connector_name").agg(F.count("*").alias("fills"), F.round(F.sum("amount"), 3).alias("amount"))


STAMPS = "(case event_id % 4 when 0 then epoch_us(ts) // 1000000 when 1 then epoch_us(ts) // 1000 when 2 then epoch_us(ts) else epoch_us(ts) * 1000 end)"


@query("epoch_dispatch", f"with s as (select event_id, {STAMPS} stamp from events) select event_id, round(case when stamp >= 1000000000000000000 then stamp / 1e9 when stamp >= 1000000000000000 then stamp / 1e6 when stamp >= 1000000000000 then stamp / 1e3 else stamp end, 3) epoch_s from s")
def epoch_dispatch(spark, d):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    k = F.col("event_id") % 4
    stamp = F.when(k == 0, F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 1000000")).when(k == 1, F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 1000")).when(k == 2, us).otherwise(us * 1000)
    return v.table(spark, d, "events").select("event_id", F.round(scalars.to_seconds(stamp), 3).alias("epoch_s"))


@query("enum_names", "select event_id, case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 end code, case event_type when 'click' then 'OPEN' when 'view' then 'FILLED' when 'purchase' then 'CANCELED' else 'UNKNOWN' end state from events")
def enum_names(spark, d):
    names = {1: "OPEN", 2: "FILLED", 3: "CANCELED"}
    code = F.create_map(*[F.lit(x) for kv in {"click": 1, "view": 2, "purchase": 3}.items() for x in kv])
    rows = v.table(spark, d, "events").select("event_id", F.try_element_at(code, F.col("event_type")).alias("code"))
    return rows.withColumn("state", scalars.named(F.col("code"), names, "UNKNOWN"))


@query("sink_append", f"with {v.STATES} select account, count(*) as rows, round(sum(value), 2) as value from states_v group by account")
def sink_append(spark, d):
    """Snapshots written as two jobs; the table holds both."""
    path, rows = f"{shared_folder(spark)}/tapeworks/snapshots-{uuid.uuid4().hex}", v.token_states(spark, d)
    for part in (F.col("token").startswith("1"), ~F.col("token").startswith("1")):
        tables.append(rows.where(part), path)
    return spark.read.parquet(path).groupBy("account").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 2).alias("value"))


@query("sink_insert_once", "select o_custkey as key, min(o_orderkey) as order_id, count(*) over () as keys from orders group by o_custkey")
def sink_insert_once(spark, d):
    """Two jobs, the second with all rows again: a key's least order is inserted once."""
    path = f"{shared_folder(spark)}/tapeworks/inserted-{uuid.uuid4().hex}"
    rows = v.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("order_id"))
    low = rows.groupBy("key").agg(F.min("order_id").alias("low"))
    tables.insert_once(rows.join(low.where("low % 2 = 0"), "key").drop("low"), path, ["key"], [F.col("order_id")])
    for _ in range(2):
        tables.insert_once(rows, path, ["key"], [F.col("order_id")])
    found = spark.read.parquet(path)
    return found.join(F.broadcast(found.agg(F.count("*").alias("keys"))))


@query("sink_patch", f"""with {v.TRADES}, e as (select order_id, (ts, line, part, supp, quote) w, case when line % 2 = 0 then price end price, case when side = 'BUY' then amount end bought, fee from trades_v)
  select order_id, round(arg_max(price, w) filter (price is not null), 6) price, arg_max(bought, w) filter (bought is not null) bought, round(arg_max(fee, w), 6) fee from e group by order_id""")
def sink_patch(spark, d):
    """Patches with null columns: the newest value of each column that is not null."""
    rows = v.trades(spark, d).select(
        "order_id", F.struct("ts", "line", "part", "supp", "quote").alias("at"), F.when(F.col("line") % 2 == 0, F.col("price")).alias("price"), F.when(F.col("side") == "BUY", F.col("amount")).alias("bought"), "fee"
    )
    return rounded(tables.patched(rows, ["order_id"], "at").drop("at"), 6, "price", "fee")


CANDLES = BARS + ", twice as (select *, 1 v from b union all select * replace (close + 1 as close), 2 from b where bar_start % 7200 = 0)"


@query("candles_tail", f"with {CANDLES}, l as (select * from twice qualify row_number() over (partition by mint order by bar_start desc, v desc) <= 50) select mint, bar_start, round(close, 6) as close from l qualify row_number() over (partition by mint, bar_start order by v desc) = 1")
def candles_tail(spark, d):
    """The newest 50 rows of each mint first, then one row for each time, the last one: fewer may remain."""
    rows = _bars(spark, d).withColumn("v", F.lit(1))
    rows = rows.union(rows.where("bar_start % 7200 = 0").withColumns({"close": F.col("close") + 1, "v": F.lit(2)}))
    kept = history.keep_last(history.newest_of(rows, ["mint"], ["bar_start", "v"], 50), ["mint", "bar_start"], ["v"])
    return rounded(kept.select("mint", "bar_start", "close"), 6, "close")


@query("candles_range", f"with {BARS} select mint, bar_start, open, high, low, close from b where mint = 3 and bar_start between 1704672000 and 1705276800")
def candles_range(spark, d):
    low, high = 1704672000, 1705276800  # bars begin at whole hours, and so does the range
    near = v.swaps(spark, d).where((F.col("mint") == 3) & (F.col("t") >= low) & (F.col("t") < high + HOUR))
    return history.search_range(tape.bars(near, HOUR, 600), {"mint": 3}, "bar_start", low, high).select("mint", "bar_start", "open", "high", "low", "close")


@query("swap_scan", f"with {v.SWAPS} select mint, trader, is_buy, volume, price, t from swaps_v where mint = 4 and t >= 1704672000 and t <= 1705276800")
def swap_scan(spark, d):
    return history.search_range(v.swaps(spark, d), {"mint": 4}, "t", 1704672000.0, 1705276800.0).select("mint", "trader", "is_buy", "volume", "price", "t")


@query("pool_listing", """select p_brand as pool, p_partkey as token, case when p_size % 10 = 0 then null else round(p_retailprice, 2) end price, p_size % 10 <> 0 as priced from part""")
def pool_listing(spark, d):
    """A nested listing as JSON (some prices are no numbers), flattened again to a row for each token."""
    token = F.struct(F.col("p_partkey").alias("token"), F.when(F.col("p_size") % 10 == 0, "n/a").otherwise(F.format_string("%.2f", "p_retailprice")).alias("price"))
    pools = v.table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(token).alias("tokens"))
    page = F.to_json(F.struct(F.array(F.struct(F.col("p_brand").alias("pool"), "tokens")).alias("pools")))
    return history.flat_pools(pools.select(page.alias("page"))).select("pool", "token", "price", F.col("price").isNotNull().alias("priced"))


TOPIC = "'ns/bot' || (user_id % 5) || '/' || event_type"


@query("topic_routes", f"with t as (select event_id, {TOPIC} topic, user_id % 5 bot, event_type from events) select event_id, 'bot' || bot bot, event_type as channel, case when event_type = 'click' then 'clicks' when bot = 3 then 'third' end route from t")
def topic_routes(spark, d):
    rows = v.table(spark, d, "events").select("event_id", F.concat(F.lit("ns/bot"), (F.col("user_id") % 5).cast("string"), F.lit("/"), "event_type").alias("topic"))
    route = F.when(scalars.matches(F.col("topic"), "ns/+/click"), "clicks").when(scalars.matches(F.col("topic"), "ns/bot3/#"), "third")
    return rows.select("event_id", F.split_part("topic", F.lit("/"), F.lit(2)).alias("bot"), F.split_part("topic", F.lit("/"), F.lit(3)).alias("channel"), route.alias("route"))
