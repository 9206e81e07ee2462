"""Queries on orders, trades, executors, snapshots and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, history, performance, portfolio
from ..sources import views as v
from .registry import query

DAY = "yyyy-MM-dd"


def day(c: str = "created_at"):
    return F.date_format(c, DAY).alias("day")


@query("orders_search", f"with {v.ORDERS} select client_order_id, status, amount, strftime(created_at, '%Y-%m-%d') as day from orders_v where account = 'BUILDING' and status in ('OPEN', 'FILLED') and created_at between '1993-01-01' and '1996-12-31' order by created_at desc, client_order_id desc limit 50")
def orders_search(spark, d):
    found = filters.search(v.orders(spark, d), {"account": "BUILDING", "nation": None}, {"status": ["OPEN", "FILLED"]}, ("created_at", "1993-01-01", "1996-12-31"))
    return filters.newest(found, ["created_at", "client_order_id"], 50).select("client_order_id", "status", "amount", day())


@query("active_orders", f"with {v.ORDERS} select client_order_id, account, status, amount from orders_v where status in ('SUBMITTED', 'OPEN', 'PARTIALLY_FILLED', 'PENDING_CANCEL') order by created_at desc, client_order_id desc limit 1000")
def active_orders(spark, d):
    found = filters.search(v.orders(spark, d), within={"status": ["SUBMITTED", "OPEN", "PARTIALLY_FILLED", "PENDING_CANCEL"]})
    return filters.newest(found, ["created_at", "client_order_id"], 1000).select("client_order_id", "account", "status", "amount")


@query("trades_search", f"with {v.ORDERS}, {v.TRADES} select account, pair, side, order_id, line, part, supp, quote from trades_v join orders_v on order_id = client_order_id where account = 'MACHINERY' and pair = 'P3' order by ts desc, order_id desc, line desc, part desc, supp desc, quote desc limit 100")
def trades_search(spark, d):
    t, o = filters.search(v.trades(spark, d), {"pair": "P3"}), filters.search(v.orders(spark, d), {"account": "MACHINERY"})
    rows = t.join(o, t.order_id == o.client_order_id)
    return filters.newest(rows, v.TRADE_ORDER, 100).select("account", "pair", "side", "order_id", "line", "part", "supp", "quote")


def _priced_orders(spark, d):
    """The orders' own columns: pages that don't show the account don't need the customers."""
    return v.table(spark, d, "orders").select(F.col("o_orderkey").alias("client_order_id"), F.col("o_totalprice").alias("amount"))


@query("page_offset", f"with {v.ORDERS} select client_order_id, amount, (select count(*) from orders_v) total_count from orders_v order by amount desc, client_order_id desc limit 20 offset 40")
def page_offset(spark, d):
    o = _priced_orders(spark, d)
    total = o.agg(F.count("*").alias("total_count"))
    return filters.newest(o, ["amount", "client_order_id"], 20, 40).select("client_order_id", "amount").join(F.broadcast(total))


@query("page_keyset", f"with {v.ORDERS} select client_order_id, amount from orders_v where (amount, client_order_id) < (200000.0, 5000) order by amount desc, client_order_id desc limit 30")
def page_keyset(spark, d):
    return filters.newest(filters.before(_priced_orders(spark, d), ["amount", "client_order_id"], (200000.0, 5000)), ["amount", "client_order_id"], 30).select("client_order_id", "amount")


@query("text_search", "select p_partkey, p_name from part where contains(lower(p_name), 'red') or contains(lower(p_brand), 'red')")
def text_search(spark, d):
    return filters.any_text(v.table(spark, d, "part"), "RED", ["p_name", "p_brand"]).select("p_partkey", "p_name")


@query("orders_summary", f"with {v.ORDERS} select account, count(*) total, count(*) filter (status = 'FILLED') filled, count(*) filter (status in ('OPEN', 'PARTIALLY_FILLED')) active, count(*) filter (status = 'FILLED') / count(*) fill_rate from orders_v group by account")
def orders_summary(spark, d):
    filled = F.count_if(F.col("status") == "FILLED")
    return v.orders(spark, d).groupBy("account").agg(F.count("*").alias("total"), filled.alias("filled"), F.count_if(F.col("status").isin("OPEN", "PARTIALLY_FILLED")).alias("active"), F.coalesce(F.try_divide(filled, F.count("*")), F.lit(0.0)).alias("fill_rate"))


@query("executor_stats", f"with {v.EXECUTORS} select executor_type, status, connector, count(*) executors, count(*) filter (status = 'RUNNING') running, round(sum(net_pnl), 2) pnl, round(sum(volume), 2) volume from executors_v group by grouping sets ((executor_type), (status), (connector), ())")
def executor_stats(spark, d):
    e = v.executors(spark, d)
    sets = [[F.col("executor_type")], [F.col("status")], [F.col("connector")], []]
    return e.groupingSets(sets, "executor_type", "status", "connector").agg(
        F.count("*").alias("executors"), F.count_if(F.col("status") == "RUNNING").alias("running"), F.round(F.sum("net_pnl"), 2).alias("pnl"), F.round(F.sum("volume"), 2).alias("volume")
    )


@query("swaps_summary", "select l_linestatus as status, count(*) swaps, round(sum(case when l_returnflag in ('A', 'N') then l_extendedprice else l_quantity end) filter (l_shipdate >= '1994-01-01'), 2) volume, round(sum(l_tax), 4) gas from lineitem group by l_linestatus")
def swaps_summary(spark, d):
    size = F.when(F.col("l_returnflag").isin("A", "N"), F.col("l_extendedprice")).otherwise(F.col("l_quantity"))
    return v.table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("status")).agg(F.count("*").alias("swaps"), F.round(F.sum(F.when(F.col("l_shipdate") >= "1994-01-01", size)), 2).alias("volume"), F.round(F.sum("l_tax"), 4).alias("gas"))


@query("funding_total", f"with {v.TRADES} select pair, round(sum(fee), 2) total, count(*) payments from trades_v where ts between '1994-01-01' and '1995-12-31' group by pair")
def funding_total(spark, d):
    return filters.search(v.trades(spark, d), between=("ts", "1994-01-01", "1995-12-31")).groupBy("pair").agg(F.round(F.sum("fee"), 2).alias("total"), F.count("*").alias("payments"))


@query("db_summary", f"with {v.TRADES} select count(*) trades, count(distinct pair) pairs, count(distinct connector) connectors, (select count(*) from orders) orders from trades_v")
def db_summary(spark, d):
    orders = v.table(spark, d, "orders").agg(F.count("*").alias("orders"))
    return v.trades(spark, d).agg(F.count("*").alias("trades"), F.count_distinct("pair").alias("pairs"), F.count_distinct("connector").alias("connectors")).join(F.broadcast(orders))


@query("source_health", " union all ".join(f"select '{t}' as source, count(*) > 0 ok from {t}" for t in ("orders", "lineitem", "customer", "events", "part", "supplier")))
def source_health(spark, d):
    one = lambda t: v.table(spark, d, t).limit(1).agg((F.count("*") > 0).alias("ok")).select(F.lit(t).alias("source"), "ok")
    first, *rest = map(one, ("orders", "lineitem", "customer", "events", "part", "supplier"))
    for r in rest:
        first = first.union(r)
    return first


@query("latest_state", f"with {v.STATES} select account, connector, token, value, units, strftime(ts, '%Y-%m-%d') as day from states_v qualify rank() over (partition by account, connector order by ts desc) = 1")
def latest_state(spark, d):
    return portfolio.latest(v.token_states(spark, d), ["account", "connector"]).select("account", "connector", "token", "value", "units", day("ts"))


LATEST = v.STATES + ", l as (select * from states_v qualify rank() over (partition by account, connector order by ts desc) = 1)"


@query("portfolio_value", f"with {LATEST} select account, round(sum(value), 2) as value from l group by rollup (account)")
def portfolio_value(spark, d):
    return portfolio.latest(v.token_states(spark, d), ["account", "connector"]).rollup("account").agg(F.round(F.sum("value"), 2).alias("value"))


def _spread(rows, *keys):
    return rows.select(*keys, F.round("value", 2).alias("value"), F.round("pct", 4).alias("pct"))


@query("token_distribution", f"with {LATEST} select token, account, connector, round(sum(value), 2) as value, round(sum(value) * 100 / (select sum(value) from l), 4) pct from l group by grouping sets ((token), (token, account), (token, account, connector))")
def token_distribution(spark, d):
    return _spread(portfolio.distribution(portfolio.latest(v.token_states(spark, d), ["account", "connector"]), [["token"], ["token", "account"], ["token", "account", "connector"]]), "token", "account", "connector")


@query("account_distribution", f"with {LATEST} select account, connector, round(sum(value), 2) as value, round(sum(value) * 100 / (select sum(value) from l), 4) pct from l group by grouping sets ((account), (account, connector))")
def account_distribution(spark, d):
    return _spread(portfolio.distribution(portfolio.latest(v.token_states(spark, d), ["account", "connector"]), [["account"], ["account", "connector"]]), "account", "connector")


@query("filtered_distribution", f"with {LATEST}, f as (select * from l where connector = 'N1' and value > 0) select token, round(sum(value), 2) as value, round(sum(value) * 100 / (select sum(value) from f), 4) pct from f group by token")
def filtered_distribution(spark, d):
    rows = portfolio.latest(v.token_states(spark, d), ["account", "connector"]).where("connector = 'N1' and value > 0")
    return _spread(portfolio.distribution(rows, [["token"]]), "token")


@query("unique_tokens", f"with {v.STATES} select distinct token from states_v")
def unique_tokens(spark, d):
    return v.token_states(spark, d).select("token").distinct()


@query("state_sampled", f"""with recursive {v.SWAPS}, r as (select mint, t, row_number() over (partition by mint order by t desc) k from (select distinct mint, t from swaps_v)),
  c as (select mint, k, t, t as last, true as emit from r where k = 1 union all select r.mint, r.k, r.t, case when last - r.t >= 21600 then r.t else last end, last - r.t >= 21600 from c join r on r.mint = c.mint and r.k = c.k + 1) select mint, t from c where emit""")
def state_sampled(spark, d):
    return portfolio.sampled(v.swaps(spark, d).select("mint", "t"), "mint", 6 * 3600.0)


RUN = v.TRADES + """, r as (select *, sum(case side when 'BUY' then amount else 0 end) over w bv, sum(case side when 'SELL' then amount else 0 end) over w sv,
  sum(case side when 'BUY' then price * amount else 0 end) over w bq, sum(case side when 'SELL' then price * amount else 0 end) over w sq, sum(fee) over w cf, sum(price * amount) over w cv,
  row_number() over (partition by pair, connector order by ts desc, order_id desc, line desc, part desc, supp desc, quote desc) rn
  from trades_v window w as (partition by pair, connector order by ts, order_id, line, part, supp, quote rows unbounded preceding)),
p as (select *, coalesce(bq / nullif(bv, 0), 0) ba, coalesce(sq / nullif(sv, 0), 0) sa from r),
q as (select *, case when ba = 0 then 0 else (sa - ba) * least(bv, sv) end realized, case when bv > sv then (price - ba) * (bv - sv) when bv < sv then (sa - price) * (sv - bv) else 0 end unrealized from p)"""  # fmt: skip


@query("trade_performance", f"with {RUN} select pair, connector, round(bv, 2) buy_volume, round(sv, 2) sell_volume, round(ba, 4) buy_avg, round(sa, 4) sell_avg, round(realized, 2) realized, round(unrealized, 2) unrealized, round(realized + unrealized - fee, 2) net_pnl, round(realized + unrealized - cf, 2) net_pnl_all_fees, round(cv, 2) cum_volume from q where rn = 1")
def trade_performance(spark, d):
    rows = performance.summary(v.trades(spark, d), ["pair", "connector"], v.TRADE_ORDER)
    two = [F.round(c, 2).alias(c) for c in ("buy_volume", "sell_volume", "realized", "unrealized", "net_pnl", "net_pnl_all_fees", "cum_volume")]
    return rows.select("pair", "connector", *two, F.round("buy_avg", 4).alias("buy_avg"), F.round("sell_avg", 4).alias("sell_avg"))


@query("trade_last_rows", f"with {RUN} select pair, connector, order_id, line, round(buy_volume, 2) buy_volume, round(net_position, 2) net_position, round(realized, 2) realized, round(unrealized - fee + realized, 2) net_pnl from (select *, bv buy_volume, bv - sv net_position from q) where rn <= 3")
def trade_last_rows(spark, d):
    """The running view of the three newest trades of each pair and connector."""
    rows = performance.running(v.trades(spark, d), ["pair", "connector"], v.TRADE_ORDER, v.month("ts"))
    kept = history.newest_of(rows, ["pair", "connector"], v.TRADE_ORDER, 3)
    return kept.select("pair", "connector", "order_id", "line", *[F.round(c, 2).alias(c) for c in ("buy_volume", "net_position", "realized", "net_pnl")])


@query("cumulative_fees", f"with {RUN} select pair, connector, round(max(cf), 2) fees, count(*) trades from q group by pair, connector")
def cumulative_fees(spark, d):
    return v.trades(spark, d).groupBy("pair", "connector").agg(F.round(F.sum("fee"), 2).alias("fees"), F.count("*").alias("trades"))


@query("max_drawdown", f"with {RUN}, f as (select pair, connector, max(greatest(realized + unrealized - cf, 0)) over (partition by pair, connector order by ts, order_id, line, part, supp, quote rows unbounded preceding) - (realized + unrealized - cf) fall from q) select pair, connector, round(max(fall), 2) max_drawdown, max(fall) > 100000 tripped from f group by pair, connector")
def max_drawdown(spark, d):
    rows = performance.running(v.trades(spark, d), ["pair", "connector"], v.TRADE_ORDER, v.month("ts"), keep=True)
    return performance.drawdown(rows, ["pair", "connector"], v.TRADE_ORDER, "net_pnl_all_fees", 100_000.0, v.month("ts")).withColumn("max_drawdown", F.round("max_drawdown", 2))


@query(
    "global_drawdown",
    f"""with {RUN}, s as (
    select *, realized + unrealized - cf as pnl, lag(realized + unrealized - cf) over (partition by pair, connector order by {v.TRADE_BY}) was from q),
  g as (select ts, {v.TRADE_BY.split(", ", 1)[1]}, sum(pnl - coalesce(was, 0)) over (order by {v.TRADE_BY} rows unbounded preceding) pnl from s),
  f as (select ts, max(greatest(pnl, 0)) over (order by {v.TRADE_BY} rows unbounded preceding) - pnl fall from g)
  select round(max(fall), 0) max_drawdown, min(ts) filter (fall > 1000000) tripped_at, max(fall) > 1000000 tripped from f""",
)
def global_drawdown(spark, d):
    """The fall of all pairs' results together, and when it would stop the strategy."""
    rows = performance.running(v.trades(spark, d), ["pair", "connector"], v.TRADE_ORDER, v.month("ts"), keep=True)
    return performance.global_drawdown(rows, ["pair", "connector"], v.TRADE_ORDER, "net_pnl_all_fees", 1_000_000.0, v.month("ts")).withColumn("max_drawdown", F.round("max_drawdown", 0))


POS = v.TRADES + """, s as (select pair, connector, sum(case side when 'BUY' then amount else 0 end) bb, sum(case side when 'SELL' then amount else 0 end) sb,
  sum(case side when 'BUY' then quote else 0 end) bq, sum(case side when 'SELL' then quote else 0 end) sq from trades_v group by pair, connector),
z as (select *, bq / nullif(bb, 0) bp, sq / nullif(sb, 0) sp from s)"""


@query("position_rollup", f"with {POS} select pair, connector, bb - sb net_base, least(bb, sb) matched, case when bb > sb then 'LONG' when bb < sb then 'SHORT' else 'FLAT' end as position, round(bp, 4) buy_price, round(sp, 4) sell_price, round(coalesce(least(bb, sb) * (sp - bp), 0), 2) realized from z")
def position_rollup(spark, d):
    p = performance.positions(v.trades(spark, d), ["pair", "connector"])
    return p.select("pair", "connector", "net_base", "matched", "position", F.round("buy_price", 4).alias("buy_price"), F.round("sell_price", 4).alias("sell_price"), F.round("realized", 2).alias("realized"))


@query("positions_summary", f"with {POS} select connector, round(sum(coalesce(least(bb, sb) * (sp - bp), 0)), 2) realized, round(sum(case when bb > sb then (bb - sb) * (1500 - bp) when bb < sb then (sb - bb) * (sp - 1500) else 0 end), 2) unrealized from z group by connector")
def positions_summary(spark, d):
    p = performance.positions(v.trades(spark, d), ["pair", "connector"])
    return p.groupBy("connector").agg(F.round(F.sum("realized"), 2).alias("realized"), F.round(F.sum(performance.unrealized(F.lit(1500.0))), 2).alias("unrealized"))


def _lp(spark, d):
    return v.table(spark, d, "part").select(
        F.col("p_partkey").alias("position"), ((F.col("p_partkey") % 5) / 1).alias("entry_price"), (F.col("p_retailprice") / 500).alias("current_price"), F.col("p_size").cast("double").alias("base0"), F.col("p_retailprice").alias("quote0"),
        (F.col("p_size") * 0.9).alias("base1"), (F.col("p_retailprice") * 1.05).alias("quote1"), (F.col("p_size") * 0.01).alias("base_fee"), (F.col("p_retailprice") * 0.01).alias("quote_fee"), F.lit(0.0).alias("opened"),
    )


LP = "lp as (select p_partkey as position, (p_partkey % 5) / 1 e, p_retailprice / 500 c, p_size::double b0, p_retailprice q0, p_size * 0.9::double b1, p_retailprice * 1.05::double q1, p_size * 0.01::double bf, p_retailprice * 0.01::double qf from part), g as (select *, e > 0 and c > 0 ok from lp)"


@query("lp_pnl", f"with {LP} select position, case when ok then round(b1 * c + q1 - b0 * c - q0, 8) end impermanent_loss, case when ok then round(b1 * c + q1 + bf * c + qf - b0 * e - q0, 8) end pnl, case when ok then round((b1 * c + q1 + bf * c + qf - b0 * e - q0) / (b0 * e + q0) * 100, 8) end pnl_pct, case when ok then round((bf * c + qf) / (b0 * e + q0) * 365.25::double * 100 / 30, 8) end fee_apr from g")
def lp_pnl(spark, d):
    rows = performance.lp_result(_lp(spark, d), F.lit(30 * 86400.0))
    return rows.select("position", *[F.round(c, 8).alias(c) for c in ("impermanent_loss", "pnl", "pnl_pct", "fee_apr")])


@query("in_range", f"with {LP} select position, case when e <= 0 or c <= 0 then 'UNKNOWN' when c between e and e * 2 then 'IN_RANGE' else 'OUT_OF_RANGE' end status from lp")
def in_range(spark, d):
    return _lp(spark, d).select("position", performance.in_range(F.col("current_price"), F.col("entry_price"), F.col("entry_price") * 2).alias("status"))


@query("pending_aged", f"with {v.ORDERS} select status, count(*) orders, count(*) filter (status = 'OPEN' and created_at < '1995-06-01') failed from orders_v group by status")
def pending_aged(spark, d):
    return v.orders(spark, d).groupBy("status").agg(F.count("*").alias("orders"), F.count_if((F.col("status") == "OPEN") & (F.col("created_at") < "1995-06-01")).alias("failed"))


@query("order_fill_fold", f"with {v.TRADES}, o as (select order_id, sum(amount) filled, arg_max(price, (ts, line, part, supp, quote)) last_fill_price, sum(quote) / sum(amount) vwap from trades_v group by order_id) select order_id, filled, round(last_fill_price, 8) last_fill_price, round(vwap, 8) vwap, case when filled >= 100 then 'FILLED' else 'PARTIALLY_FILLED' end status from o")
def order_fill_fold(spark, d):
    o = v.trades(spark, d).groupBy("order_id").agg(F.sum("amount").alias("filled"), F.round(F.max_by("price", F.struct("ts", "line", "part", "supp", "quote")), 8).alias("last_fill_price"), F.round(F.sum("quote") / F.sum("amount"), 8).alias("vwap"))
    return o.withColumn("status", F.when(F.col("filled") >= 100, "FILLED").otherwise("PARTIALLY_FILLED"))


@query("live_or_stored_union", f"with {v.EXECUTORS}, live as (select executor_id, 'live' as origin from executors_v where status = 'RUNNING'), stored as (select executor_id, 'stored' as origin from executors_v where executor_id % 3 = 0) select * from live union all select * from stored where executor_id not in (select executor_id from live)")
def live_or_stored_union(spark, d):
    e = v.executors(spark, d)
    live = e.where("status = 'RUNNING'").select("executor_id", F.lit("live").alias("origin"))
    stored = e.where("executor_id % 3 = 0").select("executor_id", F.lit("stored").alias("origin"))
    return live.unionByName(stored.join(live, "executor_id", "left_anti"))


@query("reconcile_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def reconcile_anti(spark, d):
    c, o = v.table(spark, d, "customer"), v.table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("requested_rules", f"with {v.TRADES}, rules as (select pair, min(amount) min_amount, round(min(price), 4) min_price from trades_v group by pair), r as (select unnest(['P1', 'P7', 'P99']) pair) select r.pair, min_amount, min_price, case when rules.pair is null then 'not found' end error from r left join rules using (pair)")
def requested_rules(spark, d):
    wanted = ["P1", "P7", "P99"]
    rules = filters.search(v.trades(spark, d), within={"pair": wanted}).groupBy("pair").agg(F.min("amount").alias("min_amount"), F.round(F.min("price"), 4).alias("min_price"), F.lit(True).alias("found"))
    asked = spark.createDataFrame([(p,) for p in wanted], "pair string")
    return asked.join(rules, "pair", "left").select("pair", "min_amount", "min_price", F.when(F.col("found").isNull(), "not found").alias("error"))


@query("safety_chain", "select p_partkey, case when p_retailprice < 950 then 'low liquidity' when p_size < 5 then 'too young' when p_retailprice > 1800 and p_size > 40 then 'concentrated' end reason from part")
def safety_chain(spark, d):
    rules = [("low liquidity", F.col("p_retailprice") < 950), ("too young", F.col("p_size") < 5), ("concentrated", (F.col("p_retailprice") > 1800) & (F.col("p_size") > 40))]
    return v.table(spark, d, "part").select("p_partkey", filters.first_breach(rules).alias("reason"))


@query("json_flatten", "select event_id, (props::json->>'k')::bigint k from events")
def json_flatten(spark, d):
    return v.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
