"""Queries on accounts, balances, bot runs, gateway swaps and positions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import filters, history, performance, portfolio
from ..sources import views as v
from .ledger import LATEST, POS, day
from .market import rounded
from .registry import query


@query("swaps_search", f"with {v.GATEWAY} select network, side, status, order_id, line, part, supp, round(output_amount, 2) output_amount from gateway_v where network = 'net1' and status = 'CONFIRMED' and ts between '1993-01-01' and '1996-12-31' order by ts desc, order_id desc, line desc, part desc, supp desc, output_amount desc limit 100")
def swaps_search(spark, d):
    found = filters.search(v.gateway_swaps(spark, d), {"network": "net1", "status": "CONFIRMED", "side": ""}, between=("ts", "1993-01-01", "1996-12-31"))
    rows = filters.newest(found, ["ts", "order_id", "line", "part", "supp", "output_amount"], 100)
    return rounded(rows.select("network", "side", "status", "order_id", "line", "part", "supp", "output_amount"), 2, "output_amount")


@query("executors_search", f"with {v.EXECUTORS} select executor_id, executor_type, connector, status, count(*) over () total_count from executors_v where connector in ('N1', 'N3', 'N7') and executor_type in ('1-URGENT', '2-HIGH') order by created_at desc, executor_id desc limit 50")
def executors_search(spark, d):
    """All values of each list count, and the total is that of all rows found."""
    found = filters.search(v.executors(spark, d), within={"connector": ["N1", "N3", "N7"], "executor_type": ["1-URGENT", "2-HIGH"]})
    page = filters.newest(found, ["created_at", "executor_id"], 50).select("executor_id", "executor_type", "connector", "status")
    return page.join(F.broadcast(found.agg(F.count("*").alias("total_count"))))


@query("bot_runs_search", f"with {v.RUNS} select run_id, bot, run_status from runs_v where (run_status = 'RUNNING' or run_status = 'CREATED') and deployment_status = 'DEPLOYED' order by deployed_at desc, run_id desc limit 100")
def bot_runs_search(spark, d):
    either = (F.col("run_status") == "RUNNING") | (F.col("run_status") == "CREATED")
    return filters.newest(filters.search(v.runs(spark, d), {"deployment_status": "DEPLOYED"}).where(either), ["deployed_at", "run_id"], 100).select("run_id", "bot", "run_status")


@query("run_stats", f"with {v.RUNS} select strategy_type, run_status, count(*) runs, count(*) filter (run_status = 'RUNNING' and deployment_status = 'DEPLOYED') active from runs_v group by grouping sets ((strategy_type), (run_status), ())")
def run_stats(spark, d):
    sets = [[F.col("strategy_type")], [F.col("run_status")], []]
    return v.runs(spark, d).groupingSets(sets, "strategy_type", "run_status").agg(F.count("*").alias("runs"), F.count_if((F.col("run_status") == "RUNNING") & (F.col("deployment_status") == "DEPLOYED")).alias("active"))


@query("latest_run", f"with {v.RUNS} select bot, max(run_id) run_id from (select *, rank() over (partition by bot order by deployed_at desc) r from runs_v) where r = 1 group by bot")
def latest_run(spark, d):
    """A bot's newest run, also if it has several."""
    return history.keep_last(v.runs(spark, d), ["bot"], ["deployed_at", "run_id"]).select("bot", "run_id")


@query("active_executors", f"with {v.EXECUTORS} select executor_type, connector, count(*) executors, round(sum(net_pnl), 2) pnl, round(sum(volume), 2) volume from executors_v where status = 'RUNNING' group by grouping sets ((executor_type), (connector), ())")
def active_executors(spark, d):
    e = filters.search(v.executors(spark, d), {"status": "RUNNING"})
    return e.groupingSets([[F.col("executor_type")], [F.col("connector")], []], "executor_type", "connector").agg(F.count("*").alias("executors"), F.round(F.sum("net_pnl"), 2).alias("pnl"), F.round(F.sum("volume"), 2).alias("volume"))


@query("gateway_summary", f"""with {v.GATEWAY} select network, count(*) total_swaps, count(*) filter (status = 'CONFIRMED') confirmed, count(*) filter (status = 'FAILED') failed, count(*) filter (status = 'SUBMITTED') pending,
  count(*) filter (status = 'CONFIRMED') / count(*) success_rate, round(coalesce(sum(case side when 'BUY' then output_amount else input_amount end) filter (status = 'CONFIRMED'), 0), 2) total_volume,
  round(coalesce(sum(gas_fee) filter (status = 'CONFIRMED'), 0), 4) total_gas from gateway_v group by network""")
def gateway_summary(spark, d):
    ok = F.col("status") == "CONFIRMED"
    of = lambda s: F.count_if(F.col("status") == s)
    size = F.when(F.col("side") == "BUY", F.col("output_amount")).otherwise(F.col("input_amount"))
    return v.gateway_swaps(spark, d).groupBy("network").agg(
        F.count("*").alias("total_swaps"), of("CONFIRMED").alias("confirmed"), of("FAILED").alias("failed"), of("SUBMITTED").alias("pending"), F.try_divide(of("CONFIRMED"), F.count("*")).alias("success_rate"),
        F.round(F.sum(F.when(ok, size).otherwise(0.0)), 2).alias("total_volume"), F.round(F.coalesce(F.sum(F.when(ok, F.col("gas_fee"))), F.lit(0.0)), 4).alias("total_gas"),
    )


@query("funding_currency", f"with {v.TRADES} select pair, round(sum(fee), 2) total, count(*) payments, arg_min(connector, (ts, order_id, line, part, supp, quote)) fee_currency from trades_v group by pair")
def funding_currency(spark, d):
    first = F.min_by("connector", F.struct(*v.TRADE_ORDER))
    return v.trades(spark, d).groupBy("pair").agg(F.round(F.sum("fee"), 2).alias("total"), F.count("*").alias("payments"), first.alias("fee_currency"))


@query("db_values", f"with {v.TRADES} select count(*) trades, (select string_agg(pair, ',' order by pair) from (select distinct pair from trades_v)) pairs, (select string_agg(connector, ',' order by connector) from (select distinct connector from trades_v)) connectors from trades_v")
def db_values(spark, d):
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s")
    return v.trades(spark, d).agg(F.count("*").alias("trades"), listed("pair"), listed("connector"))


@query("account_state", f"with {LATEST} select connector, token, round(value, 2) as value, strftime(ts, '%Y-%m-%d') as day from l where account = 'BUILDING'")
def account_state(spark, d):
    rows = filters.search(v.token_states(spark, d), {"account": "BUILDING"})
    return portfolio.latest(rows, ["account", "connector"]).select("connector", "token", F.round("value", 2).alias("value"), day("ts"))


@query("newest_state", f"with {v.STATES} select account, connector, token, strftime(ts, '%Y-%m-%d') as day from states_v where account = 'MACHINERY' and connector = 'N2' order by ts desc, token limit 1")
def newest_state(spark, d):
    rows = filters.search(v.token_states(spark, d), {"account": "MACHINERY", "connector": "N2"})
    return rows.orderBy(F.desc("ts"), "token").limit(1).select("account", "connector", "token", day("ts"))


@query("state_tree", f"with {LATEST} select account, connector, string_agg(token || '=' || units, ';' order by token) tokens from l group by account, connector")
def state_tree(spark, d):
    """Accounts with their newest snapshot's tokens, parent and children."""
    rows = portfolio.latest(v.token_states(spark, d), ["account", "connector"])
    parents = rows.select("account", "connector", F.concat_ws("/", "account", "connector").alias("key")).distinct()
    tree = history.with_children(parents, rows.withColumn("key", F.concat_ws("/", "account", "connector")), "key", ["token", "units"])
    return tree.select("account", "connector", F.array_join(F.transform("children", lambda c: F.concat_ws("=", c["token"], c["units"])), ";").alias("tokens"))


@query("state_period", f"with {v.SWAPS} select mint, strftime(make_timestamp((floor(t / 86400) * 86400 * 1000000)::bigint), '%Y-%m-%d') as day, arg_min(price, t) price, arg_min(volume, t) volume from swaps_v group by all")
def state_period(spark, d):
    states = v.swaps(spark, d).select(F.timestamp_seconds("t").alias("ts"), "mint", "price", "volume")
    return history.by_period(states, ["mint"], "day").select("mint", day("period"), "price", "volume")


HISTORY = f"with {v.ORDERS} select client_order_id, strftime(created_at, '%Y-%m-%d') as day, count(*) over () > 40 has_more from (select * from orders_v where {{}} order by created_at desc, client_order_id desc limit 41) qualify row_number() over (order by created_at desc, client_order_id desc) <= 40"


def _history(spark, d, cursor):
    return history.cursor_page(v.orders(spark, d), "created_at", "client_order_id", cursor, 40).select("client_order_id", day(), "has_more")


@query("history_page", HISTORY.format("created_at < '1995-03-01'"))
def history_page(spark, d):
    return _history(spark, d, "1995-03-01 00:00:00")


@query("history_bad_cursor", HISTORY.format("true"))
def history_bad_cursor(spark, d):
    """A malformed cursor is ignored."""
    return _history(spark, d, "yesterday?")


ID_PAGE = f"with {v.ORDERS}, m as (select created_at c, client_order_id i from orders_v where client_order_id = {{}}) select client_order_id, account from orders_v where (select count(*) from m) = 0 or (created_at, client_order_id) < (select (c, i) from m) order by created_at desc, client_order_id desc limit 25"


def _after(spark, d, cursor):
    rows = history.after_id(v.orders(spark, d), ["created_at", "client_order_id"], "client_order_id", cursor)
    return filters.newest(rows, ["created_at", "client_order_id"], 25).select("client_order_id", "account")


@query("page_after_id", ID_PAGE.format(777))
def page_after_id(spark, d):
    return _after(spark, d, 777)


@query("page_unknown_id", ID_PAGE.format(-5))
def page_unknown_id(spark, d):
    """An unknown cursor gives the first page."""
    return _after(spark, d, -5)


@query("accounts_history", f"with {v.STATES} select account, connector, token, strftime(ts, '%Y-%m-%d') as day, round(value, 2) as value from states_v where account in ('BUILDING', 'FURNITURE') order by ts desc, account, connector, token limit 200")
def accounts_history(spark, d):
    rows = filters.search(v.token_states(spark, d), within={"account": ["BUILDING", "FURNITURE"]})
    return rows.orderBy(F.desc("ts"), "account", "connector", "token").limit(200).select("account", "connector", "token", day("ts"), F.round("value", 2).alias("value"))


@query("distribution_sorted", f"with {LATEST} select token, round(sum(value), 2) as value, row_number() over (order by round(sum(value), 2) desc, token) as place from l where value > 0 group by token")
def distribution_sorted(spark, d):
    rows = portfolio.latest(v.token_states(spark, d), ["account", "connector"]).where("value > 0").groupBy("token").agg(F.round(F.sum("value"), 2).alias("value"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "token")).cast("long"))  # a row for each token


@query("active_bots", f"with {v.RUNS} select bot from runs_v where run_status = 'RUNNING' and strategy_type = '1-URGENT' union select bot from runs_v where run_status = 'CREATED'")
def active_bots(spark, d):
    r = v.runs(spark, d)
    return filters.search(r, {"run_status": "RUNNING", "strategy_type": "1-URGENT"}).select("bot").union(filters.search(r, {"run_status": "CREATED"}).select("bot")).distinct()


@query("inactive_bots", f"with {v.RUNS} select distinct bot, account from runs_v where (bot, account) not in (select (bot, account) from runs_v where run_status = 'CREATED' and strategy_type = '1-URGENT' and deployment_status = 'ARCHIVED')")
def inactive_bots(spark, d):
    r = v.runs(spark, d)
    named = filters.search(r, {"run_status": "CREATED", "strategy_type": "1-URGENT", "deployment_status": "ARCHIVED"})
    return r.select("bot", "account").distinct().join(named, ["bot", "account"], "left_anti")


@query("unknown_orders", "select l_orderkey order_id, count(*) fills from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O') group by l_orderkey")
def unknown_orders(spark, d):
    """Fills whose order is not among the open ones."""
    known = v.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order_id"))
    return v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("fills")).join(known, "order_id", "left_anti")


@query("reopened", "select o_orderkey order_id from orders where o_orderstatus = 'F' and o_orderkey in (select l_orderkey from lineitem where l_linestatus = 'O')")
def reopened(spark, d):
    """Closed orders that still have open lines."""
    live = v.table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return v.table(spark, d, "orders").where("o_orderstatus = 'F'").join(live, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("order_id"))


@query("wallet_configs", "select distinct l_returnflag as network, l_linestatus as connector, l_suppkey % 10 as wallet from lineitem")
def wallet_configs(spark, d):
    return v.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("network"), F.col("l_linestatus").alias("connector"), (F.col("l_suppkey") % 10).alias("wallet")).dropDuplicates(["network", "connector", "wallet"])


@query("position_addresses", "select distinct l_suppkey as address from lineitem where l_linestatus = 'O' and l_returnflag = 'N'")
def position_addresses(spark, d):
    return v.table(spark, d, "lineitem").where("l_linestatus = 'O' and l_returnflag = 'N'").select(F.col("l_suppkey").alias("address")).distinct()


@query("point_lookup", f"with {v.ORDERS} select client_order_id, account, status from orders_v where client_order_id = 42 limit 1")
def point_lookup(spark, d):
    return filters.search(v.orders(spark, d), {"client_order_id": 42}).limit(1).select("client_order_id", "account", "status")


@query("key_exists", "select k as key, exists (select 1 from orders where o_orderkey = k) found from (values (1), (42), (-7)) t(k)")
def key_exists(spark, d):
    asked = spark.createDataFrame([(1,), (42,), (-7,)], "key long")
    held = v.table(spark, d, "orders").join(F.broadcast(asked), F.col("o_orderkey") == F.col("key"), "left_semi").select(F.col("o_orderkey").alias("key"), F.lit(True).alias("found"))
    return asked.join(held.distinct(), "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


@query("api_rows", "select l_orderkey order_id, l_linenumber line, l_partkey part, l_suppkey supp, l_discount discount, nullif(l_discount, 0) discount_or_null, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') shipped from lineitem")
def api_rows(spark, d):
    """Rows as an interface gives them: zero kept, and as null where it means that there is none."""
    return v.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_discount").alias("discount"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount_or_null"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("shipped"),
    )


@query("connector_kind", f"with {v.EXECUTORS}, c as (select *, connector || case when executor_id % 2 = 0 then '_perpetual' else '' end name from executors_v) select name, count(*) executors from c where contains(name, '_perpetual') group by name")
def connector_kind(spark, d):
    name = F.concat("connector", F.when(F.col("executor_id") % 2 == 0, "_perpetual").otherwise(""))
    return v.executors(spark, d).withColumn("name", name).where(F.col("name").contains("_perpetual")).groupBy("name").agg(F.count("*").alias("executors"))


@query("allowed_balances", "select p_partkey, 'T' || (p_partkey % 7) token, p_size units from part where p_size > 10 and p_partkey % 7 not in (2, 5)")
def allowed_balances(spark, d):
    """Balances that are not small, without banned tokens."""
    banned = spark.createDataFrame([("T2",), ("T5",)], "token string")
    rows = v.table(spark, d, "part").select("p_partkey", F.concat(F.lit("T"), F.col("p_partkey") % 7).alias("token"), F.col("p_size").alias("units"))
    return rows.where("units > 10").join(F.broadcast(banned), "token", "left_anti").select("p_partkey", "token", "units")


@query("position_events", "select l_orderkey order_id, count(*) events, round(sum(l_extendedprice), 2) quote from orders join lineitem on l_orderkey = o_orderkey where o_custkey between 10 and 40 group by l_orderkey")
def position_events(spark, d):
    """Events of the positions at some addresses: address to id to events in one join."""
    held = v.table(spark, d, "orders").where("o_custkey between 10 and 40").select(F.col("o_orderkey").alias("order_id"))
    lines = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_extendedprice")
    return held.join(lines, "order_id").groupBy("order_id").agg(F.count("*").alias("events"), F.round(F.sum("l_extendedprice"), 2).alias("quote"))


RATES = "rates as (select 'T' || (s_suppkey % 7) token, round(avg(s_acctbal), 2) rate, s_suppkey % 7 k from supplier group by all)"
BALANCES = "balances as (select p_partkey account, case when p_size % 9 = 0 then 'USDT' else 'T' || (p_partkey % 7) end token, p_size::double units from part)"


def _rates(spark, d):
    k = F.col("s_suppkey") % 7
    return v.table(spark, d, "supplier").groupBy(F.concat(F.lit("T"), k).alias("token"), k.alias("k")).agg(F.round(F.avg("s_acctbal"), 2).alias("rate"))


def _balances(spark, d):
    token = F.when(F.col("p_size") % 9 == 0, "USDT").otherwise(F.concat(F.lit("T"), F.col("p_partkey") % 7))
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("account"), token.alias("token"), F.col("p_size").cast("double").alias("units"))


@query("token_prices", f"""with {RATES}, {BALANCES}, o as (select token, rate from rates where k < 3), e as (select token, rate from rates where k between 2 and 4),
  p as (select account, token, units, case when contains(token, 'USD') then 1 when o.rate > 0 then o.rate else coalesce(e.rate, 0) end price, case when contains(token, 'USD') then 'dollar' when o.rate > 0 then 'oracle' when e.rate is not null then 'exchange' else 'none' end as source
  from balances left join o using (token) left join e using (token)) select account, token, round(price, 2) price, source, round(price * units, 2) as value from p""")
def token_prices(spark, d):
    r = _rates(spark, d)
    rows = history.priced(_balances(spark, d), r.where("k < 3"), r.where("k between 2 and 4"))
    return rounded(rows.select("account", "token", "price", "source", "value"), 2, "price", "value")


UNREALIZED = POS + f", {RATES}, named as (select *, case when pair = 'P0' then pair else 'T' || (substr(pair, 2)::int % 7) || '-USD' end name from z), u as (select name, connector, bb, sb, bp, sp, rate from named left join (select token, rate from rates where k < 5) r on token = split_part(name, '-', 1) and name like '%-%'), w as (select name, connector, case when rate is null then null when bb > sb then (bb - sb) * (rate - bp) when bb < sb then (sb - bb) * (sp - rate) else 0 end un from u)"


@query("position_unrealized", f"with {UNREALIZED} select connector, count(*) positions, count(un) priced, round(sum(un), 2) unrealized from w group by connector")
def position_unrealized(spark, d):
    """Result of open positions by the rate of their pair's base; null while no pair has a rate."""
    pairs = F.when(F.col("pair") == "P0", F.col("pair")).otherwise(F.concat(F.lit("T"), F.substr("pair", F.lit(2)).cast("int") % 7, F.lit("-USD")))
    p = performance.positions(v.trades(spark, d), ["pair", "connector"]).withColumn("name", pairs)
    p = p.withColumn("token", F.when(F.col("name").contains("-"), F.split_part("name", F.lit("-"), F.lit(1))))
    rows = p.join(_rates(spark, d).where("k < 5").select("token", "rate"), "token", "left").withColumn("un", F.when(F.col("rate").isNotNull(), performance.unrealized(F.col("rate"))))
    return rows.groupBy("connector").agg(F.count("*").alias("positions"), F.count("un").alias("priced"), F.round(F.sum("un"), 2).alias("unrealized"))


@query("merged_positions", f"with {v.TRADES} select pair, round(sum(amount), 2) amount, round(sum(fee), 2) fee, (select string_agg(c, ',' order by c) from (select distinct connector c from trades_v x where x.pair = t.pair)) connectors from trades_v t group by pair")
def merged_positions(spark, d):
    parts = v.trades(spark, d).groupBy("pair", "connector").agg(F.sum("amount").alias("amount"), F.sum("fee").alias("fee"), F.collect_set("connector").alias("connectors"))
    rows = history.merged(parts, ["pair"], ["amount", "fee"], ["connectors"])
    return rows.select("pair", F.round("amount", 2).alias("amount"), F.round("fee", 2).alias("fee"), F.array_join("connectors", ",").alias("connectors"))


@query("level_analysis", f"""with {v.TRADES} select pair, connector as level, count(*) filter (side = 'BUY') trading, count(*) filter (side = 'SELL') waiting, strftime(max(ts) filter (line > 1), '%Y-%m-%d') last_update, round(min(price), 8) min_price, round(max(price), 8) max_price
  from trades_v where supp % 4 <> 0 group by pair, connector""")
def level_analysis(spark, d):
    rows = v.trades(spark, d).where("supp % 4 <> 0")
    return rows.groupBy("pair", F.col("connector").alias("level")).agg(
        F.count_if(F.col("side") == "BUY").alias("trading"), F.count_if(F.col("side") == "SELL").alias("waiting"), F.date_format(F.max(F.when(F.col("line") > 1, F.col("ts"))), "yyyy-MM-dd").alias("last_update"),
        F.round(F.min("price"), 8).alias("min_price"), F.round(F.max("price"), 8).alias("max_price"),
    )


@query("arbitrage_imbalance", f"""with {v.EXECUTORS}, e as (select *, executor_id % 2 as side from executors_v) select executor_type, count(*) filter (status = 'TERMINATED' and side = 0) - count(*) filter (status = 'TERMINATED' and side = 1) imbalance,
  coalesce(epoch(max(created_at) filter (status = 'TERMINATED' and side = 0)), 0)::bigint last_buy, coalesce(epoch(max(created_at) filter (status = 'TERMINATED' and side = 1)), 0)::bigint last_sell,
  count(*) filter (status <> 'TERMINATED' and side = 0) active_buys, count(*) filter (status <> 'TERMINATED' and side = 1) active_sells from e group by executor_type""")
def arbitrage_imbalance(spark, d):
    side, done = F.col("executor_id") % 2, F.col("status") == "TERMINATED"
    last = lambda s: F.coalesce(F.max(F.when(done & (side == s), v.epoch("created_at"))), F.lit(0)).cast("long")
    return v.executors(spark, d).groupBy("executor_type").agg(
        (F.count_if(done & (side == 0)) - F.count_if(done & (side == 1))).alias("imbalance"), last(0).alias("last_buy"), last(1).alias("last_sell"),
        F.count_if(~done & (side == 0)).alias("active_buys"), F.count_if(~done & (side == 1)).alias("active_sells"),
    )


@query("portfolio_targets", f"""with {LATEST}, a as (select account, token, sum(value) actual from l group by all), w(token, weight) as (values ('1-URGENT', 0.3), ('2-HIGH', 0.3), ('3-MEDIUM', 0.2), ('5-LOW', 0.1), ('QUOTE', 0.1)),
  t as (select account, sum(actual) total from a group by account), g as (select account, token, weight, total from t, w)
  select g.account, g.token, round(coalesce(actual, 0), 2) actual, round(total * weight, 2) theoretical, round(coalesce(actual, 0) - total * weight, 2) difference from g left join a using (account, token)""")
def portfolio_targets(spark, d):
    weights = spark.createDataFrame([("1-URGENT", 0.3), ("2-HIGH", 0.3), ("3-MEDIUM", 0.2), ("5-LOW", 0.1), ("QUOTE", 0.1)], "token string, weight double")
    actual = portfolio.latest(v.token_states(spark, d), ["account", "connector"]).groupBy("account", "token").agg(F.sum("value").alias("actual"))
    wanted = actual.groupBy("account").agg(F.sum("actual").alias("total")).join(F.broadcast(weights))  # five rows an account
    rows = wanted.join(actual, ["account", "token"], "left").withColumns({"actual": F.coalesce("actual", F.lit(0.0)), "theoretical": F.col("total") * F.col("weight")})
    return rounded(rows.withColumn("difference", F.col("actual") - F.col("theoretical")), 2, "actual", "theoretical", "difference").select("account", "token", "actual", "theoretical", "difference")


REPORT = "case event_id % 3 when 0 then '{\"performance\":{\"pnl\":' || round(value, 2) || '},\"custom_info\":{\"k\":\"' || event_type || '\"}}' when 1 then '{\"pnl\":' || round(value, 2) || '}' else '{\"pnl\":\"bad\"}' end"


@query("controller_reports", "select event_id, case event_id % 3 when 2 then 'error' else 'running' end status, case when event_id % 3 < 2 then round(value, 2) end pnl, case when event_id % 3 = 0 then event_type end k from events")
def controller_reports(spark, d):
    """Reports of the nested and the flat kind in one form; one whose figures are no numbers is an error."""
    e = v.table(spark, d, "events")
    text = F.round("value", 2).cast("string")
    nested = F.concat(F.lit('{"performance":{"pnl":'), text, F.lit('},"custom_info":{"k":"'), "event_type", F.lit('"}}'))
    report = F.when(F.col("event_id") % 3 == 0, nested).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"pnl":'), text, F.lit("}"))).otherwise('{"pnl":"bad"}')
    pnl = F.coalesce(F.get_json_object("report", "$.performance.pnl"), F.get_json_object("report", "$.pnl"))
    rows = e.withColumn("report", report).select("event_id", pnl.alias("text"), F.get_json_object("report", "$.custom_info.k").alias("k"))
    number = F.expr("try_cast(text as double)")
    return rows.select("event_id", F.when(number.isNull(), "error").otherwise("running").alias("status"), number.alias("pnl"), "k")


@query("session_summary", f"""with {v.TRADES}, r as (select *, row_number() over (partition by pair order by ts desc, order_id desc, line desc, part desc, supp desc, quote desc) k from trades_v)
  select pair, count(*) trades, round(sum(case side when 'SELL' then quote else -quote end), 4) pnl, string_agg(order_id || ':' || side, ' ' order by k desc) filter (k <= 5) recent from r group by pair""")
def session_summary(spark, d):
    """Counts, result and the last five trades in order of time."""
    pnl = F.when(F.col("side") == "SELL", F.col("quote")).otherwise(-F.col("quote"))
    totals = v.trades(spark, d).groupBy("pair").agg(F.count("*").alias("trades"), F.round(F.sum(pnl), 4).alias("pnl"))
    last = history.newest_of(v.trades(spark, d), ["pair"], v.TRADE_ORDER, 5).groupBy("pair").agg(F.sort_array(F.collect_list(F.struct(*v.TRADE_ORDER, "side"))).alias("l"))
    return totals.join(last, "pair").select("pair", "trades", "pnl", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["order_id"], x["side"])), " ").alias("recent"))


@query("best_pool", "select p_brand as token, arg_max(p_partkey, (coalesce(case when p_size > 10 then p_retailprice end, 0), p_partkey)) pool, round(max(coalesce(case when p_size > 10 then p_retailprice end, 0)), 2) liquidity from part group by p_brand")
def best_pool(spark, d):
    """The pool with the most liquidity (none counts as 0)."""
    deep = F.coalesce(F.when(F.col("p_size") > 10, F.col("p_retailprice")), F.lit(0.0))
    return v.table(spark, d, "part").groupBy(F.col("p_brand").alias("token")).agg(F.max_by("p_partkey", F.struct(deep, F.col("p_partkey"))).alias("pool"), F.round(F.max(deep), 2).alias("liquidity"))


@query("fees_accrued", f"""with {v.TRADES} select pair, round(sum(case when line > 2 then fee else 0 end), 4) collected, round(sum(case when line <= 2 then fee else 0 end) filter ((ts, order_id, line, part, supp, quote) > coalesce(last, (timestamp '1900-01-01', 0, 0, 0, 0, 0.0))), 4) pending
  from trades_v join (select pair p, max((ts, order_id, line, part, supp, quote)) filter (line > 2) last from trades_v group by pair) on p = pair group by pair""")
def fees_accrued(spark, d):
    """Fees collected so far; what is pending since the last collection (which sets it to 0)."""
    t = v.trades(spark, d)
    at = F.struct(*v.TRADE_ORDER)
    last = t.groupBy("pair").agg(F.max(F.when(F.col("line") > 2, at)).alias("last"))
    later = F.col("last").isNull() | (at > F.col("last"))
    return t.join(last, "pair").groupBy("pair").agg(
        F.round(F.sum(F.when(F.col("line") > 2, F.col("fee")).otherwise(0.0)), 4).alias("collected"), F.round(F.sum(F.when(later, F.when(F.col("line") <= 2, F.col("fee")).otherwise(0.0))), 4).alias("pending")
    )


@query("due_snapshots", f"""with {v.SWAPS}, o as (select mint as key, max(t) since from swaps_v group by mint), n as (select max(t) now from swaps_v), s(snapshot, off) as (values ('t0', 0), ('t5m', 300), ('t1h', 3600), ('t6h', 21600))
  select key, snapshot from o, n, s where now - since >= off and not (snapshot = 't0' and key % 2 = 0)""")
def due_snapshots(spark, d):
    t = v.swaps(spark, d)
    seen = t.groupBy(F.col("mint").alias("key")).agg(F.max("t").alias("since"))
    schedule = spark.createDataFrame([("t0", 0), ("t5m", 300), ("t1h", 3600), ("t6h", 21600)], "snapshot string, offset int")
    done = seen.where("key % 2 = 0").select("key", F.lit("t0").alias("snapshot"))
    now = F.coalesce(t.agg(F.max("t")).scalar(), F.lit(0.0))
    return history.due(seen, schedule, done, now)


@query("pools_of_mints", f"with {v.SWAPS}, p as (select distinct trader pool, mint from swaps_v where trader % 3 = 0) select pool, mint, count(*) swaps from swaps_v join p using (mint) where trader = pool or is_buy = 0 group by all")
def pools_of_mints(spark, d):
    """Swaps credited to every pool that a mint has."""
    t = v.swaps(spark, d)
    pools = t.where("trader % 3 = 0").select(F.col("trader").alias("pool"), "mint").distinct()
    counted = t.groupBy("mint", "trader", "is_buy").agg(F.count("*").alias("n"))
    return counted.join(pools, "mint").where("trader = pool or is_buy = 0").groupBy("pool", "mint").agg(F.sum("n").alias("swaps"))


@query("funnel", """with c as (select user_id % 10 as stream, count(*) received, count(*) filter (event_type <> 'error') matched, count(*) filter (event_type = 'signup') failed, count(*) filter (event_type = 'error' and value < 100) dropped, count(*) filter (event_type in ('signup', 'error')) sampled from events group by 1)
  select stream, round(matched / greatest(received, 1) * 100, 4) match_pct, round(failed / greatest(matched, 1) * 100, 4) fail_pct, round(dropped / greatest(matched, 1) * 100, 4) drop_pct, round(failed / nullif(sampled, 0), 4) orphan_rate, coalesce(sampled >= 100 and failed / nullif(sampled, 0) > 0.05, false) alert from c""")
def funnel(spark, d):
    kind = F.col("event_type")
    c = v.table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("stream")).agg(
        F.count("*").alias("received"), F.count_if(kind != "error").alias("matched"), F.count_if(kind == "signup").alias("failed"), F.count_if((kind == "error") & (F.col("value") < 100)).alias("dropped"), F.count_if(kind.isin("signup", "error")).alias("sampled")
    )
    pct = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)) * 100, 4)
    orphan = F.try_divide("failed", "sampled")
    return c.select(
        "stream", pct("matched", "received").alias("match_pct"), pct("failed", "matched").alias("fail_pct"), pct("dropped", "matched").alias("drop_pct"), F.round(orphan, 4).alias("orphan_rate"),
        F.coalesce((F.col("sampled") >= 100) & (orphan > 0.05), F.lit(False)).alias("alert"),
    )


@query("json_group", "select (props::json->>'k')::bigint k, count(*) events, round(sum(value), 2) as value from events group by 1")
def json_group(spark, d):
    return v.table(spark, d, "events").groupBy(F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))


@query("json_numbers", "select event_id, round(value, 2) price, (props::json->>'k')::double k, case when event_id % 2 = 0 then 'text' else 'number' end kind from events")
def json_numbers(spark, d):
    """Two-level JSON whose numbers may be strings, as doubles."""
    e = v.table(spark, d, "events")
    text = F.round("value", 2).cast("string")
    price = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    blob = F.concat(F.lit('{"info":{"price":'), price, F.lit('},"security":'), "props", F.lit("}"))
    rows = e.select("event_id", F.parse_json(blob).alias("v"))
    kind = F.when(F.schema_of_variant(F.variant_get("v", "$.info.price", "variant")) == "STRING", "text").otherwise("number")
    return rows.select("event_id", F.try_variant_get("v", "$.info.price", "double").alias("price"), F.try_variant_get("v", "$.security.k", "double").alias("k"), kind.alias("kind"))


@query("wrapped_tokens", "select p_partkey, case when p_brand like 'W%' then substr(p_brand, 2) else p_brand end token, upper(p_type) kind, split_part(p_name, ' ', 1) as first_word from part")
def wrapped_tokens(spark, d):
    """Names without the prefix of wrapped tokens, in one case, and their parts."""
    return v.table(spark, d, "part").select("p_partkey", scalars.unwrapped(F.col("p_brand")).alias("token"), F.upper("p_type").alias("kind"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"))


@query("trader_lists", f"with {v.SWAPS}, f as (select mint, trader, min(t) t from swaps_v group by all) select mint, count(*) traders, string_agg(trader, ',' order by t) filter (k <= 5) first_five from (select *, row_number() over (partition by mint order by t) k from f) group by mint")
def trader_lists(spark, d):
    """Traders in the order in which they came, the first five."""
    first = v.swaps(spark, d).groupBy("mint", "trader").agg(F.min("t").alias("t"))
    five = first.withColumn("k", F.row_number().over(Window.partitionBy("mint").orderBy("t"))).where("k <= 5")
    listed = five.groupBy("mint").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "trader"))), lambda x: x["trader"].cast("string")), ",").alias("first_five"))
    return first.groupBy("mint").agg(F.count("*").alias("traders")).join(listed, "mint")


def gate(rules: list[tuple[str, Column]]) -> Column:
    """Names of all gates that a row fails."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in rules])), ",")


@query("listing_gates", "select p_partkey, concat_ws(',', case when p_retailprice < 1000 then 'liquidity' end, case when p_size < 5 then 'age' end, case when p_size / 50 > case when p_retailprice > 1500 then 0.5 else 0.3 end then 'holders' end) failed from part")
def listing_gates(spark, d):
    """Gates on liquidity, age and holders, the last one wider for deep pools."""
    limit = F.when(F.col("p_retailprice") > 1500, 0.5).otherwise(0.3)
    return v.table(spark, d, "part").select("p_partkey", gate([("liquidity", F.col("p_retailprice") < 1000), ("age", F.col("p_size") < 5), ("holders", F.col("p_size") / 50 > limit)]).alias("failed"))


@query("candidate_order", "select p_partkey, row_number() over (order by p_retailprice * p_size desc, p_partkey) as place from part order by p_retailprice * p_size desc, p_partkey limit 100")
def candidate_order(spark, d):
    """The hundred candidates of the highest score, in order."""
    top = v.table(spark, d, "part").withColumn("score", F.col("p_retailprice") * F.col("p_size")).orderBy(F.desc("score"), "p_partkey").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "p_partkey")).cast("long")).select("p_partkey", "place")


@query("sampled_page", f"with {v.SWAPS}, s as (select mint, floor(t / 21600)::bigint slot, max(t) t from swaps_v where mint = 2 group by all) select mint, slot, t from s order by t desc limit 20")
def sampled_page(spark, d):
    """One state of each six hours, then the page: no more rows than needed are fetched first."""
    rows = v.swaps(spark, d).where("mint = 2").groupBy("mint", F.floor(F.col("t") / 21600).alias("slot")).agg(F.max("t").alias("t"))
    return filters.newest(rows, ["t"], 20)

