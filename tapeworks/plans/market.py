"""Queries on swap tapes, bars, order books and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book, indicators, tape
from ..sources import views as v
from .registry import query

HOUR = 3600


def rounded(df, places: int, *columns: str):
    return df.withColumns({c: F.round(c, places) for c in columns})


BARS = v.SWAPS + f""", b as (select mint, (floor(t / {HOUR}) * {HOUR})::bigint bar_start, arg_min(price, t) as open, max(price) high, min(price) low, arg_max(price, t) as close, sum(volume) volume, count(*) trades,
  count(*) filter (is_buy = 1) buys, count(*) filter (is_buy = 0) sells,
  coalesce(sum(price * volume) filter (t >= floor(t / {HOUR}) * {HOUR} + {HOUR - 600}) / nullif(sum(volume) filter (t >= floor(t / {HOUR}) * {HOUR} + {HOUR - 600}), 0), arg_max(price, t)) vwap_close from swaps_v group by all)"""


def _bars(spark, d):
    return tape.bars(v.swaps(spark, d), HOUR, 600)


@query("bars", f"with {BARS} select mint, bar_start, open, high, low, close, round(volume, 4) volume, trades, buys, sells, round(vwap_close, 6) vwap_close from b")
def bars(spark, d):
    return rounded(rounded(_bars(spark, d), 4, "volume"), 6, "vwap_close")


@query("bars_filled", f"""with {BARS}, g as (select mint, unnest(generate_series(min(bar_start), max(bar_start), {HOUR})) bar_start from b group by mint), j as (select g.mint, g.bar_start, open, high, low, volume, trades,
  last_value(close ignore nulls) over (partition by g.mint order by g.bar_start) as close from g left join b using (mint, bar_start))
  select mint, bar_start, coalesce(open, close) as open, coalesce(high, close) high, coalesce(low, close) low, close, round(coalesce(volume, 0), 4) volume, coalesce(trades, 0) trades from j""")
def bars_filled(spark, d):
    return rounded(tape.filled(_bars(spark, d), HOUR), 4, "volume").select("mint", "bar_start", "open", "high", "low", "close", "volume", "trades")


@query("weighted_median", f"with {v.SWAPS}, c as (select mint, price, sum(volume) over (partition by mint order by price, t rows unbounded preceding) cum, sum(volume) over (partition by mint) total from swaps_v) select mint, min(price) filter (cum >= total / 2) median_price, count(*) swaps from c group by mint")
def weighted_median(spark, d):
    return tape.weighted_median(v.swaps(spark, d), F.col("volume"))


@query("recent_median", f"with {v.SWAPS} select mint, round(median(price), 6) median_price from (select * from swaps_v qualify row_number() over (partition by mint order by t desc) <= 7) group by mint")
def recent_median(spark, d):
    return rounded(tape.recent_median(v.swaps(spark, d)), 6, "median_price")


@query("short_trend", f"with {v.SWAPS}, r as (select *, row_number() over (partition by mint order by t) a, row_number() over (partition by mint order by t desc) z from swaps_v), s as (select mint, case when count(*) >= 5 then median(price) filter (z <= 3) / median(price) filter (a <= 3) - 1 end trend from r group by mint) select mint, round(trend, 6) trend, case when trend < -0.1 then 'active_dump' when trend > 0.1 then 'pump_top' else 'neutral' end signal from s")
def short_trend(spark, d):
    return rounded(tape.short_trend(v.swaps(spark, d), -0.1, 0.1), 6, "trend")


@query("confirmed_mask", f"with {v.SWAPS} select mint, count(*) swaps, count(*) filter (n >= 3) confirmed, max(price) filter (n >= 3) confirmed_peak from (select a.mint, a.t, a.price, (select count(*) from swaps_v b where b.mint = a.mint and b.t between a.t - 3600 and a.t + 3600 and b.price >= 0.8 * a.price) n from swaps_v a) group by mint")
def confirmed_mask(spark, d):
    rows = tape.confirmed(v.swaps(spark, d), 3600)
    return rows.groupBy("mint").agg(F.count("*").alias("swaps"), F.count_if("confirmed").alias("confirmed"), F.max(F.when(F.col("confirmed"), F.col("price"))).alias("confirmed_peak"))


@query("branching", f"with {v.SWAPS} select mint, sum(n)::bigint successors from (select mint, count(*) over (partition by mint, is_buy order by t range between current row and 7200.0 following) - count(*) over (partition by mint, is_buy order by t range between current row and current row) n from swaps_v) group by mint")
def branching(spark, d):
    return tape.branching(v.swaps(spark, d), 7200).groupBy("mint").agg(F.sum("successors").alias("successors"))


@query("log_returns", f"with {v.SWAPS}, r as (select mint, ln(price / lag(price) over (partition by mint order by t)) r from swaps_v) select mint, count(r) n, round(avg(r), 8) mean, round(stddev_pop(r), 6) volatility from r group by mint")
def log_returns(spark, d):
    return tape.log_returns(v.swaps(spark, d)).groupBy("mint").agg(F.count("log_return").alias("n"), F.round(F.avg("log_return"), 8).alias("mean"), F.round(F.stddev_pop("log_return"), 6).alias("volatility"))


@query("impact", f"with {v.SWAPS}, a as (select *, price - lag(price) over w d, abs(ln(price / lag(price) over w)) / greatest(volume, 0.01) l from swaps_v window w as (partition by mint order by t)), b as (select *, lag(d) over (partition by mint order by t) e from a) select mint, case when count(*) >= 10 then round(median(l), 8) end kyle_lambda, round(case when covar_samp(d, e) < 0 then 2 * sqrt(-covar_samp(d, e)) else 0 end, 6) roll_spread from b group by mint")
def impact(spark, d):
    return rounded(rounded(tape.impact(v.swaps(spark, d)), 8, "kyle_lambda"), 6, "roll_spread")


@query("vpin", f"with {v.SWAPS}, b as (select mint, floor(t / 14400) k, count(*) n, sum(case when is_buy = 1 then volume else 0 end) buy, sum(volume) vol from swaps_v group by all) select mint, round(avg(abs(2 * buy - vol) / nullif(vol, 0)), 6) vpin, count(*) buckets from b where n >= 3 group by mint")
def vpin(spark, d):
    return rounded(tape.vpin(v.swaps(spark, d), 14400), 6, "vpin")


@query("order_flow", f"""with {v.SWAPS}, s as (select mint, trader, sum(volume) v from swaps_v where is_buy = 1 group by all), h as (select mint, v / sum(v) over (partition by mint) s, row_number() over (partition by mint order by v desc, trader) r from s),
  c as (select mint, sum(s * s) hhi, sum(s) filter (r <= 3) top3 from h group by mint)
  select mint, round(sum(case when is_buy = 1 then volume else -volume end) / sum(volume), 6) ofi, round(avg(volume), 6) mean_size, round(stddev_pop(volume), 6) std_size, round(quantile_cont(volume, 0.9), 6) p90, round(quantile_cont(volume, 0.1), 6) p10, count(distinct trader) unique_traders, round(coalesce(any_value(hhi), 1), 6) hhi, round(coalesce(any_value(top3), 1), 6) top3
  from swaps_v left join c using (mint) group by mint""")
def order_flow(spark, d):
    return rounded(tape.flow(v.swaps(spark, d)), 6, "ofi", "mean_size", "std_size", "p90", "p10", "hhi", "top3")


@query("streaks", f"with {v.SWAPS}, r as (select *, sum(is_buy) over (partition by mint order by t rows unbounded preceding) isle, lag(is_buy) over (partition by mint order by t) was from swaps_v), m as (select mint, max(n) sell_streak from (select mint, isle, count(*) filter (is_buy = 0) n from r group by all) group by mint) select mint, any_value(sell_streak) sell_streak, count(*) filter (is_buy <> was) switches, round(arg_max(price, t) / max(price) - 1, 6) drawdown from r join m using (mint) group by mint")
def streaks(spark, d):
    return rounded(tape.streaks(v.swaps(spark, d)), 6, "drawdown")


@query("new_buyer_growth", f"with {v.SWAPS} select mint, bucket::bigint bucket, count(*) new_buyers from (select mint, trader, min(floor(t / 86400)) bucket from swaps_v where is_buy = 1 group by all) group by all")
def new_buyer_growth(spark, d):
    return tape.new_buyers(v.swaps(spark, d), 86400)


@query("new_highs", f"""with recursive {v.SWAPS}, r as (select mint, price, row_number() over (partition by mint order by t, price) k from swaps_v),
  c as (select mint, k, price high, 0::bigint n from r where k = 1 union all select r.mint, r.k, case when r.price > high * (1 + 0.05::double) then r.price else high end, n + (r.price > high * (1 + 0.05::double))::int from c join r on r.mint = c.mint and r.k = c.k + 1) select mint, max(n) new_highs from c group by mint""")
def new_highs(spark, d):
    return tape.new_highs(v.swaps(spark, d))


SIDE = v.BOOK + ", r as (select *, case side when 'ask' then price else -price end best from book_v)"


@query("book_depth", f"with {SIDE} select pair, side, price, amount, row_number() over (partition by pair, side order by best) as level from r qualify level <= 5")
def book_depth(spark, d):
    return book.depth(v.book(spark, d), 5).withColumn("level", F.col("level").cast("long"))


def _walk_sql(size: str, base: str, volume: float) -> str:
    return f"with {SIDE}, c as (select *, {size} size, sum({size}) over (partition by pair, side order by best rows unbounded preceding) cum from r), k as (select *, greatest(least(size, {volume} - (cum - size)), 0) take from c) select pair, side, arg_min(price, cum) filter (cum >= {volume}) price, round(sum({base} * price) / nullif(sum({base}), 0), 4) vwap, round(sum(take), 2) taken, max(cum) >= {volume} enough from k group by pair, side"


@query("book_walk_volume", _walk_sql("amount", "take", 5000.0))
def book_walk_volume(spark, d):
    return rounded(rounded(book.walk(v.book(spark, d), 5000.0), 4, "vwap"), 2, "taken")


@query("book_walk_quote", _walk_sql("price * amount", "take / price", 400000.0))
def book_walk_quote(spark, d):
    return rounded(rounded(book.walk(v.book(spark, d), 400000.0, quote=True), 4, "vwap"), 2, "taken")


@query("book_volume_for_price", f"with {v.BOOK} select pair, side, sum(case when (side = 'ask' and price <= 3200) or (side = 'bid' and price >= 3200) then amount else 0 end) volume, sum(case when (side = 'ask' and price <= 3200) or (side = 'bid' and price >= 3200) then amount * price else 0 end) quote_volume from book_v group by pair, side")
def book_volume_for_price(spark, d):
    return book.volume_for_price(v.book(spark, d), F.lit(3200.0))


@query("bollinger_signal", f"with {BARS}, w as (select mint, bar_start, close, case when count(*) over k = 20 then avg(close) over k end mid, case when count(*) over k = 20 then 2 * stddev_pop(close) over k end dv from b window k as (partition by mint order by bar_start rows 19 preceding)) select mint, bar_start, round((close - mid + dv) / nullif(2 * dv, 0), 4) bbp, round(200 * dv / mid, 4) bbb, case when (close - mid + dv) / nullif(2 * dv, 0) < 0 then 1 when (close - mid + dv) / nullif(2 * dv, 0) > 1 then -1 else 0 end signal from w")
def bollinger_signal(spark, d):
    return rounded(indicators.bollinger(_bars(spark, d), 20, 2.0), 4, "bbp", "bbb").select("mint", "bar_start", "bbp", "bbb", "signal")


@query("ema", f"""with recursive {BARS}, o as (select mint, bar_start, close, row_number() over (partition by mint order by bar_start) i from b), s as (select mint, avg(close) filter (i <= 12) s, count(*) n from o group by mint),
  e as (select o.mint, i, s x from o join s on s.mint = o.mint where i = 12 union all select o.mint, o.i, o.close * (2.0 / 13)::double + e.x * (1 - (2.0 / 13)::double) from e join o on o.mint = e.mint and o.i = e.i + 1) select o.mint, o.bar_start, round(x, 8) ema from o left join e on e.mint = o.mint and e.i = o.i""")
def ema(spark, d):
    return rounded(indicators.ema(_bars(spark, d), 12), 8, "ema")


@query("spread_zscore", f"with {BARS}, p as (select x.mint k, x.bar_start i, x.close x, y.close y from b x join b y on y.mint = x.mint + 1 and y.bar_start = x.bar_start where x.mint % 2 = 0), s as (select k, regr_slope(y, x) b, regr_intercept(y, x) a from p group by k), r as (select k, i, y - a - b * x r from p join s using (k)) select k, round(any_value(a), 6) alpha, round(any_value(b), 6) beta, round((arg_max(r, i) - avg(r)) / nullif(stddev_pop(r), 0), 4) zscore from r join s using (k) group by k")
def spread_zscore(spark, d):
    b = _bars(spark, d)
    x = b.where("mint % 2 = 0").select(F.col("mint").alias("k"), F.col("bar_start").alias("i"), F.col("close").alias("x"))
    y = b.select((F.col("mint") - 1).alias("k"), F.col("bar_start").alias("i"), F.col("close").alias("y"))
    return rounded(rounded(indicators.spread_zscore(x.join(y, ["k", "i"])), 6, "alpha", "beta"), 4, "zscore")


@query("inventory_skew", "select p_partkey, round(greatest(least((40 - p_size) / 30, 1), 0.2), 6) buy_skew, round(greatest(least((p_size - 10) / 30, 1), 0.2), 6) sell_skew from part")
def inventory_skew(spark, d):
    buy, sell = indicators.inventory_skew(F.col("p_size").cast("double"), F.lit(10.0), F.lit(40.0), 0.2)
    return v.table(spark, d, "part").select("p_partkey", F.round(buy, 6).alias("buy_skew"), F.round(sell, 6).alias("sell_skew"))
