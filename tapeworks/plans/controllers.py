"""Queries on controllers' arithmetic and on swaps from balance changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import book, controllers, indicators, quantiles, tape
from ..sources import views as v
from .market import BARS, HOUR, _bars, rounded
from .registry import query

N = 20


def _series(spark, d, mints):
    return _bars(spark, d).where(f"mint % 2 = {mints}").select((F.col("mint") - mints).alias("k"), F.col("bar_start").alias("at"), F.col("close").alias("value"))


PAIRED = BARS + f""", q as (select mint - mint % 2 k, mint % 2 s, close as v, {N} - row_number() over (partition by mint order by bar_start desc) i from b qualify i >= 0 and count(*) over (partition by mint) >= {N}),
  p as (select x.k, x.i, x.v x, y.v y from q x join q y on x.k = y.k and x.i = y.i where x.s = 0 and y.s = 1), gr as (select k, i, x / first_value(x) over w gx, y / first_value(y) over w gy from p where i > 0 window w as (partition by k order by i)),
  ft as (select k, regr_slope(gy, gx) beta, regr_intercept(gy, gx) alpha from gr group by k), sp as (select k, i, (gy - alpha - beta * gx) / (alpha + beta * gx) * 100 s from gr join ft using (k)), zs as (select k, arg_max(s, i) spread, (arg_max(s, i) - avg(s)) / nullif(stddev_pop(s), 0) z from sp group by k)"""


@query("pair_signal", f"with {PAIRED} select k, round(alpha, 5) alpha, round(beta, 5) beta, round(spread, 5) spread, round(z, 4) zscore, case when z > 0.5 then 1 when z < -0.5 then -1 else 0 end signal from zs join ft using (k)")
def pair_signal(spark, d):
    """Two mints' last closes matched by position, as growth, with the regression's spread and its signal."""
    rows = controllers.pair_spread(_series(spark, d, 0), _series(spark, d, 1), N, 0.5)
    return rounded(rounded(rows, 5, "alpha", "beta", "spread"), 4, "zscore")


@query("growth", f"with {BARS}, q as (select mint k, close as v, {N} - row_number() over (partition by mint order by bar_start desc) i from b qualify i >= 0 and count(*) over (partition by mint) >= {N}) select k, i, round(v / first_value(v) over (partition by k order by i), 6) growth from q where i > 0")
def growth(spark, d):
    """The cumulative product of returns, starting at 1, is the price over the first return's price."""
    rows = controllers.last_by_position(_bars(spark, d).select(F.col("mint").alias("k"), F.col("bar_start").alias("at"), F.col("close").alias("value")), N)
    return rows.withColumn("growth", F.round(controllers.growth(rows, "value"), 6)).where("i > 0").select("k", F.col("i").cast("long").alias("i"), "growth")


@query("pct_returns", f"with {BARS}, r as (select mint, close / lag(close) over (partition by mint order by bar_start) - 1 r from b) select mint, count(r) n, round(avg(r), 6) mean, round(max(r), 6) highest, round(min(r), 6) lowest from r group by mint")
def pct_returns(spark, d):
    r = _bars(spark, d).withColumn("r", F.try_divide("close", F.lag("close").over(indicators.by_bar())) - 1)
    return r.groupBy("mint").agg(F.count("r").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.max("r"), 6).alias("highest"), F.round(F.min("r"), 6).alias("lowest"))


@query("price_divergence", f"with {BARS}, g as (select mint, case when trades % 3 = 0 then null else close end a, case when trades % 4 = 0 then null else vwap_close * 1.004 end v from b), f as (select *, abs(v - a) / a d from g) select mint, count(*) filter (a is null) a_null, count(*) filter (v is null) b_null, count(d) compared, count(*) filter (d > 0.01) over_1, count(*) filter (d > 0.02) over_2, count(*) filter (d > 0.05) over_5 from f group by mint")
def price_divergence(spark, d):
    rows = _bars(spark, d).select("mint", F.when(F.col("trades") % 3 != 0, F.col("close")).alias("a"), F.when(F.col("trades") % 4 != 0, F.col("vwap_close") * 1.004).alias("v"))
    return controllers.divergence(rows, ["mint"], "a", "v", {"over_1": 0.01, "over_2": 0.02, "over_5": 0.05})


PARTS = "p as (select p_partkey k, p_size * 10.0::double dominant, p_retailprice / 10 hedge from part)"


@query("imbalance_gate", f"with {PARTS}, s as (select k, dominant - hedge imbalance, dominant - hedge * 1.5 scaled, coalesce((dominant - hedge * 1.5) / nullif(dominant, 0), 0) x from p) select k, round(imbalance, 4) imbalance, round(scaled, 4) scaled, round(x, 6) as share, case when x > 0.5 then 'dominant' when x < -0.5 then 'hedge' end blocked from s".replace("1.5", "1.5::double"))
def imbalance_gate(spark, d):
    rows = v.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 10.0).alias("dominant"), (F.col("p_retailprice") / 10).alias("hedge"))
    cols = controllers.imbalance(F.col("dominant"), F.col("hedge"), 1.5, 0.5)
    return rows.select("k", F.round(cols["imbalance"], 4).alias("imbalance"), F.round(cols["scaled"], 4).alias("scaled"), F.round(cols["share"], 6).alias("share"), cols["blocked"].alias("blocked"))


@query("inventory_deviation", "with p as (select p_partkey k, case when p_size % 5 <> 0 then p_size * 20.0::double end held, (p_size - 25)::double result, p_retailprice total from part) select k, round(coalesce((total * 0.4::double - held) / (total * 0.4::double), 1), 6) deviation, round(coalesce(held / total, 0), 6) base_pct, round(coalesce(result / nullif(held, 0), 0), 6) pnl_pct from p")
def inventory_deviation(spark, d):
    held = F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 20.0)
    cols = controllers.inventory(held, (F.col("p_size") - 25).cast("double"), F.col("p_retailprice"), 0.4)
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("k"), *[F.round(c, 6).alias(n) for n, c in cols.items()])


LADDER = "b as (select p_partkey k, p_retailprice reference, greatest(least((40 - p_size) / 30, 1), 0.2) bs, greatest(least((p_size - 10) / 30, 1), 0.2) ss, p_size / 50 x from part), l as (select k, x, side, level, reference * (1 + case side when 'BUY' then -spread else spread end) price, 100 * case side when 'BUY' then bs else ss end amount from b, (values ('BUY', 0, 0.01::double), ('BUY', 1, 0.02::double), ('BUY', 2, 0.04::double), ('SELL', 0, 0.01::double), ('SELL', 1, 0.02::double), ('SELL', 2, 0.04::double)) t(side, level, spread))"


def _ladder(spark, d):
    rows = v.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("reference"), F.col("p_size").cast("double").alias("size"), (F.col("p_size") / 50).alias("x"))
    buy, sell = indicators.inventory_skew(F.col("size"), F.lit(10.0), F.lit(40.0), 0.2)
    return controllers.ladder(rows, [0.005, 0.01, 0.02], 2.0, buy, sell, F.lit(100.0))


@query("price_ladder", f"with {LADDER} select k, side, level, round(price, 4) price, round(amount, 4) amount from l")
def price_ladder(spark, d):
    return rounded(_ladder(spark, d), 4, "price", "amount").select("k", "side", "level", "price", "amount")


@query("open_levels", f"with {LADDER} select k, side, level from l where (k, side, level) not in (select (k, side, level) from l where (k + level) % 3 = 0) and not (x < 0.3 and side = 'SELL') and not (x > 0.7 and side = 'BUY')")
def open_levels(spark, d):
    """Levels without an active order, buys only under the band and sells only over it."""
    wanted = _ladder(spark, d)
    active = wanted.where((F.col("k") + F.col("level")) % 3 == 0).select("k", "side", "level")
    return controllers.open_levels(wanted, active, ["k"], F.col("x"), 0.3, 0.7).select("k", "side", "level")


@query("dca_amounts", "with p as (select p_partkey k, p_retailprice total, case when p_size % 2 = 0 then [1.0::double, 2, p_size] end a from part) select k, round(coalesce(total * a[1] / list_sum(a), total / 3), 4) as first, round(coalesce(total * a[2] / list_sum(a), total / 3), 4) as second, round(coalesce(total * a[3] / list_sum(a), total / 3), 4) as third from p")
def dca_amounts(spark, d):
    """A total in proportion to given amounts, or in equal parts."""
    even = F.col("p_size") % 2 == 0
    given = F.array(*[F.when(even, x.cast("double")) for x in (F.lit(1.0), F.lit(2.0), F.col("p_size"))])
    parts = v.table(spark, d, "part").select(F.col("p_partkey").alias("k"), controllers.parts_of(given, F.col("p_retailprice")).alias("a"))
    return parts.select("k", *[F.round(F.get("a", i), 4).alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("grid_params", f"""with {BARS}, w as (select mint, bar_start, close, avg(close) over k mid, 2 * stddev_pop(close) over k dv, count(*) over k n from b window k as (partition by mint order by bar_start rows 19 preceding)),
  s as (select *, case when n = 20 then (close - mid + dv) / nullif(2 * dv, 0) end bbp, case when n = 20 then 2 * dv / mid end width from w), g as (select *, case when bbp < 0.3 then 1 when bbp > 0.7 then -1 else 0 end sg from s)
  select mint, bar_start, sg signal, round(case sg when -1 then close * (1 - width * 0.3) when 1 then close * (1 - width * 0.1) end, 5) start_price, round(case sg when -1 then close * (1 + width * 0.1) when 1 then close * (1 + width * 0.3) end, 5) end_price, round(case sg when -1 then close * (1 + width * 0.4) when 1 then close * (1 - width * 0.4) end, 5) limit_price from g""")
def grid_params(spark, d):
    rows = indicators.bollinger(_bars(spark, d), 20, 2.0, 0.3, 0.7)
    cols = controllers.grid(F.col("close"), F.col("bbb") / 100, F.col("signal"), 0.1, 0.3, 0.4)
    return rows.select("mint", "bar_start", "signal", *[F.round(c, 5).alias(n) for n, c in cols.items()])


@query("backtest_summary", f"""with {BARS}, r as (select mint, bar_start, close / lag(close) over (partition by mint order by bar_start) - 1 r from b), s as (select *, sum(r) over (partition by mint order by bar_start rows unbounded preceding) c from r where r is not null), f as (select *, greatest(max(c) over (partition by mint order by bar_start rows unbounded preceding), 0) - c fall from s)
  select mint, count(*) trades, round(sum(r), 6) total, round(avg(r), 6) mean, round(stddev_pop(r), 6) deviation, round(coalesce(avg(r) / nullif(stddev_pop(r), 0) * sqrt(365), 0), 5) sharpe, round(max(fall), 6) max_fall from f group by mint""")
def backtest_summary(spark, d):
    r = _bars(spark, d).withColumn("r", F.try_divide("close", F.lag("close").over(indicators.by_bar())) - 1).where("r is not null")
    return rounded(rounded(controllers.backtest(r, "mint", "bar_start", "r", 365), 6, "total", "mean", "deviation", "max_fall"), 5, "sharpe")


@query("reserve_liquidity", "select p_partkey, round(case when p_size - 20 > 0 then 2 * (p_size - 20)::double else p_retailprice end, 4) liquidity from part")
def reserve_liquidity(spark, d):
    return v.table(spark, d, "part").select("p_partkey", F.round(controllers.liquidity((F.col("p_size") - 20).cast("double"), F.col("p_retailprice")), 4).alias("liquidity"))


DELTAS = """e as (select event_id tx, case when event_id % 11 = 0 then 0 else floor(epoch_us(ts) / 1000000)::bigint end t, event_id % 7 = 0 failed, user_id trader, case when event_type in ('click', 'view') then 1 when event_type = 'purchase' then -1 else 0 end * round(value * 1000000)::bigint lam,
  case when event_type in ('click', 'signup') then 1 else -1 end * (event_id % 13) tok from events)"""


@query("curve_swaps", f"with {DELTAS} select tx, t, trader, (lam > 0)::int is_buy, abs(lam) / 1e9 volume, abs(tok)::bigint base_amount, round(abs(lam) / 1e9 / abs(tok), 9) price from e where not failed and t > 0 and lam * tok > 0")
def curve_swaps(spark, d):
    """Two balance changes for each transaction, joined to swaps again where their signs agree."""
    e, kind = v.table(spark, d, "events"), F.col("event_type")
    sign = F.when(kind.isin("click", "view"), 1).when(kind == "purchase", -1).otherwise(0)
    lam = sign * F.round(F.col("value") * 1_000_000).cast("long")
    tok = F.when(kind.isin("click", "signup"), 1).otherwise(-1) * (F.col("event_id") % 13)
    t = F.when(F.col("event_id") % 11 == 0, 0).otherwise(F.floor(v.epoch("ts")))
    one = lambda role, owner, a, b: F.struct(F.lit(role).alias("role"), owner.alias("owner"), a.alias("lamports"), b.alias("tokens"))
    zero = F.lit(0).cast("long")
    legs = F.explode(F.array(one("curve", F.lit(-1).cast("long"), lam, zero), one("signer", F.col("user_id"), zero, tok)))
    rows = e.select(F.col("event_id").alias("tx"), t.alias("t"), (F.col("event_id") % 7 == 0).alias("failed"), legs.alias("x")).select("tx", "t", "failed", "x.*")
    return controllers.curve_swaps(rows).withColumn("price", F.round("price", 9))


SIDES = v.BOOK + ", s as (select pair, max(price) filter (side = 'bid') best_bid, min(price) filter (side = 'ask') best_ask, count(*) filter (side = 'bid') bids, count(*) filter (side = 'ask') asks from book_v group by pair)"


@query("book_summary", f"with {SIDES} select pair, best_bid, best_ask, bids, asks, best_ask - best_bid spread, best_bid >= best_ask crossed from s")
def book_summary(spark, d):
    """Best prices, levels of both sides and the spread of each book."""
    return book.summary(v.book(spark, d))


@query("top_shares", f"with {v.SWAPS}, s as (select mint, trader, sum(volume) v from swaps_v where is_buy = 1 group by all), h as (select mint, v / sum(v) over (partition by mint) s, row_number() over (partition by mint order by v desc, trader) r from s) select mint, round(sum(s) filter (r <= 1), 6) top1, round(sum(s) filter (r <= 3), 6) top3, round(sum(s) filter (r <= 5), 6) top5, round(sum(s * s) filter (r <= 5) / 0.2, 6) hhi_top5 from h group by mint")
def top_shares(spark, d):
    w = Window.partitionBy("mint")
    own = v.swaps(spark, d).where("is_buy = 1").groupBy("mint", "trader").agg(F.sum("volume").alias("v"))
    h = own.select("mint", (F.col("v") / F.sum("v").over(w)).alias("s"), F.row_number().over(w.orderBy(F.desc("v"), "trader")).alias("r"))
    top = lambda k, x="s": F.round(F.sum(F.when(F.col("r") <= k, x if not isinstance(x, str) else F.col(x))), 6)
    return h.groupBy("mint").agg(top(1).alias("top1"), top(3).alias("top3"), top(5).alias("top5"), top(5, F.col("s") * F.col("s") / 0.2).alias("hhi_top5"))


@query("size_moments", f"with {v.SWAPS}, q as (select *, avg(volume) over (partition by mint) m, stddev_pop(volume) over (partition by mint) s from swaps_v) select mint, round(avg(volume), 6) mean, round(any_value(s) / any_value(m), 6) cv, round(quantile_cont(volume, 0.95), 6) p95, round(avg(pow(volume - m, 3)) / pow(any_value(s), 3), 5) skew from q group by mint")
def size_moments(spark, d):
    t = v.swaps(spark, d)
    rows = t.groupBy("mint").agg(F.round(F.avg("volume"), 6).alias("mean"), F.round(F.stddev_pop("volume") / F.avg("volume"), 6).alias("cv"), F.round(F.skewness("volume"), 5).alias("skew"))
    return rounded(rows.join(quantiles.exact(t, ["mint"], "volume", {"p95": 0.95}), "mint", "left"), 6, "p95")


@query("arrival_gaps", f"with {v.SWAPS}, r as (select mint, t - lag(t) over (partition by mint order by t) gap from swaps_v) select mint, count(*) gaps, round(min(gap), 4) shortest, round(median(gap), 4) middle, round(max(gap), 4) longest from r where gap > 0 group by mint")
def arrival_gaps(spark, d):
    r = tape.gaps(v.swaps(spark, d)).where("gap > 0")
    rows = r.groupBy("mint").agg(F.count("*").alias("gaps"), F.round(F.min("gap"), 4).alias("shortest"), F.round(F.max("gap"), 4).alias("longest"))
    return rounded(rows.join(quantiles.exact(r, ["mint"], "gap", {"middle": 0.5}), "mint"), 4, "middle")


@query("grid_scan", f"with {v.SWAPS}, g as (select mint, unnest(generate_series((floor(min(t) / {24 * HOUR}) * {24 * HOUR})::bigint, max(t)::bigint, {24 * HOUR})) slot from swaps_v group by mint), n as (select mint, (floor(t / {24 * HOUR}) * {24 * HOUR})::bigint slot, count(*) n from swaps_v group by all) select mint, slot, coalesce(n, 0) swaps from g left join n using (mint, slot)")
def grid_scan(spark, d):
    """A row for each mint and day of its span, also days without swaps."""
    t, day = v.swaps(spark, d), 24 * HOUR
    span = t.groupBy("mint").agg((F.floor(F.min("t") / day) * day).cast("long").alias("a"), F.round(F.max("t")).cast("long").alias("b"))
    grid = span.select("mint", F.explode(F.sequence("a", "b", F.lit(day).cast("long"))).alias("slot"))
    own = t.groupBy("mint", (F.floor(F.col("t") / day) * day).cast("long").alias("slot")).agg(F.count("*").alias("swaps"))
    return grid.join(own, ["mint", "slot"], "left").fillna(0, ["swaps"])
