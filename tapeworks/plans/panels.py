"""Queries on feature panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panels
from ..sources import views as v
from .market import HOUR, rounded
from .registry import query

DAY = 24 * HOUR


@query("intensity", f"""with {v.SWAPS}, r as (select *, max(t) over (partition by mint) - t age from swaps_v), s as (select mint, coalesce(sum(exp(-age / {HOUR}.0)) filter (is_buy = 1), 0) b, coalesce(sum(exp(-age / {HOUR}.0)) filter (is_buy = 0), 0) s from r where age <= {DAY} group by mint)
  select mint, round(b, 6) buy_intensity, round(s, 6) sell_intensity, round(coalesce(b / nullif(b + s, 0), 0.5), 6) buy_share from s""")
def intensity(spark, d):
    return rounded(panels.intensity(v.swaps(spark, d), DAY, HOUR), 6, "buy_intensity", "sell_intensity", "buy_share")


@query("label_drawdown", f"""with {v.SWAPS}, r as (select *, t - min(t) over (partition by mint) - {DAY} age from swaps_v), s as (select mint, count(*) filter (age <= {DAY}) swaps, min(price) filter (age <= {DAY}) / case when count(*) filter (age <= {2 * HOUR}) >= 3 then median(price) filter (age <= {2 * HOUR}) else arg_min(price, t) end - 1 f from r where age >= 0 group by mint)
  select mint, swaps, round(case when swaps >= 3 then f end, 6) drawdown, case when swaps >= 3 then (f <= -0.35)::int end as label from s""")
def label_drawdown(spark, d):
    return rounded(panels.label_drawdown(v.swaps(spark, d), DAY, 2 * HOUR, DAY, -0.35), 6, "drawdown")


#: The tape has a swap of a mint about every 45 minutes, so the panels' second is 24 minutes here, and a start is ten days after the first swap.
UNIT, WAIT, DUST, STEP = 1440, 10 * DAY, 2.0, 6 * HOUR


def starts(tape):
    return tape.groupBy("mint").agg((F.min("t") + WAIT).alias("g"))


def closes(tape):
    """The last price of all swaps in each bucket."""
    return tape.groupBy((F.floor(F.col("t") / STEP) * STEP).cast("long").alias("bucket")).agg(F.max_by("price", "t").alias("close"))


OPEN = v.SWAPS + f""", g as (select mint, min(t) + {WAIT} g from swaps_v group by mint), w as (select s.*, g, t - g age from swaps_v s join g using (mint) where t - g >= 0 and t - g <= {300 * UNIT} and volume >= {DUST})"""


@query("panel5", f"""with recursive {OPEN}, o as (select *, row_number() over (partition by mint order by t) k from w), f as (select mint, median(price) filter (k <= 5) ref, max(price) peak, count(*) valid from o group by mint),
  e as (select mint, trader, sum(volume) v from w where is_buy = 1 and age <= {60 * UNIT} group by all), h as (select mint, v / sum(v) over (partition by mint) s, row_number() over (partition by mint order by v desc, trader) r from e), t as (select mint, sum(s * s) filter (r <= 5) / 0.2 hhi from h group by mint),
  c as (select mint, k, price high, 0 n from o where k = 1 union all select o.mint, o.k, case when price > high * 1.05 then price else high end, n + (price > high * 1.05)::int from c join o on o.mint = c.mint and o.k = c.k + 1), nh as (select mint, max(n) n from c group by mint),
  s as (select mint, count(*) swaps, sum(case when is_buy = 0 then volume else 0 end) / sum(volume) sell_share, stddev_pop(volume) / avg(volume) cv from w group by mint)
  select mint, round(least((peak - ref) / ref, 100), 6) peak_pnl, nh.n::bigint recoveries, round(coalesce(hhi, 0), 6) hhi_top5, round(sell_share, 6) sell_share, round(cv, 6) size_cv, swaps from s join f using (mint) join nh using (mint) left join t using (mint) where swaps >= 5 and valid >= 5""")
def panel5(spark, d):
    tape = v.swaps(spark, d)
    return rounded(panels.panel5(tape, starts(tape), UNIT, DUST), 6, "peak_pnl", "hhi_top5", "sell_share", "size_cv")


VOLATILITY = f"""c as (select (floor(t / {STEP}) * {STEP})::bigint bucket, arg_max(price, t) as close from swaps_v group by 1), k as (select mint, g, unnest(range(13)) k from g),
  m as (select mint, k, close, lead(close) over (partition by mint order by k) before from k left join c on bucket = (floor((g - k * {STEP}) / {STEP}) * {STEP})::bigint), vol as (select mint, case when count((close - before) / before) filter (k < 12) >= 6 then stddev_pop((close - before) / before) filter (k < 12) end volatility from m group by mint)"""


@query("pre_event_vol", f"with {OPEN}, {VOLATILITY} select mint, round(volatility, 6) volatility from vol")
def pre_event_vol(spark, d):
    tape = v.swaps(spark, d)
    return rounded(panels.pre_event_volatility(closes(tape), starts(tape), STEP), 6, "volatility")


PANEL = OPEN + f""", {VOLATILITY}, tot as (select mint, count(*) filter (age <= {60 * UNIT})::double swap_count_60, count(*)::double swap_count_300, count(*) filter (age <= {60 * UNIT}) / 60.0 / (count(*) / 300.0) density_ratio, avg(volume) filter (age <= {60 * UNIT}) mean_size_60,
  avg(volume) mean_size_300, quantile_cont(volume, 0.95) p95_size, sum(volume) total_volume, count(distinct trader)::double unique_traders, (count(distinct trader) - count(distinct trader) filter (age <= {60 * UNIT})) / nullif(count(distinct trader) filter (age <= {60 * UNIT}), 0) new_trader_rate,
  count(*) filter (is_buy = 1) / count(*) buy_count_share, count(*) filter (is_buy = 0) / count(*) sell_count_share, sum(case when is_buy = 1 then volume else -volume end) / sum(volume) ofi, max(volume) / sum(volume) top1_swap_share, floor(max(g) % 86400 / 3600)::double start_hour from w group by mint),
  r1 as (select *, ln(price) - ln(lag(price) over (partition by mint order by t)) r from w), r2 as (select *, lag(r) over (partition by mint order by t) q from r1),
  pr as (select mint, count(*) valid, arg_max(price, t) / max(price) - 1 drawdown, case when count(*) >= 10 then median(abs(r) / greatest(volume, 0.01)) end kyle_lambda, case when count(*) >= 10 then case when covar_samp(r, q) < 0 then 2 * sqrt(-covar_samp(r, q)) else 0 end end roll_spread from r2 group by mint),
  sure as (select * from w a where (select count(*) from w b where b.mint = a.mint and b.t between a.t - {5 * UNIT} and a.t + {5 * UNIT} and b.price >= 0.8 * a.price) >= 3),
  pk as (select *, lag(price) over (partition by mint order by t) a, lead(price) over (partition by mint order by t) b from sure), pe as (select mint, case when count(*) >= 2 then arg_max(price, t) / max(price) - 1 end drawdown_confirmed, case when count(*) >= 2 then (count(*) filter (price > a and price > b))::double end local_maxima from pk group by mint),
  bk as (select mint, floor(age / {30 * UNIT}) k, count(*) n, sum(case when is_buy = 1 then volume else -volume end) dv, sum(volume) v from w where age < {300 * UNIT} group by all), vp as (select mint, avg(abs(dv) / v) vpin from bk where n >= 3 and v > 0 group by mint),
  st as (select *, sum(is_buy) over (partition by mint order by t rows unbounded preceding) isle, lag(is_buy) over (partition by mint order by t) was from w), sr as (select mint, max(n)::double sell_streak from (select mint, isle, count(*) filter (is_buy = 0) n from st group by all) group by mint), sw as (select mint, count(*) filter (is_buy <> was)::double switches from st group by mint),
  byr as (select mint, trader, sum(volume) v from w where is_buy = 1 group by all), bs as (select mint, v / sum(v) over (partition by mint) s, row_number() over (partition by mint order by v desc, trader) k from byr), bh as (select mint, sum(s * s) buyer_hhi, sum(s) filter (k <= 3) buyer_top3 from bs group by mint),
  panel as (select * from tot join pr using (mint) left join pe using (mint) left join vp using (mint) left join sr using (mint) left join sw using (mint) left join bh using (mint) left join vol using (mint) where swap_count_300 >= 10 and valid >= 5)"""  # fmt: skip


def _panel(spark, d, names):
    tape = v.swaps(spark, d)
    rows = panels.panel22(tape, starts(tape), UNIT, DUST).join(panels.pre_event_volatility(closes(tape), starts(tape), STEP), "mint", "left")
    return rounded(rows.select("mint", *names, "volatility"), 6, *names, "volatility")


def _panel_sql(names):
    return f"with {PANEL} select mint, " + ", ".join(f"round({n}, 6) {n}" for n in (*names, "volatility")) + " from panel"


@query("panel18", _panel_sql(panels.PANEL18))
def panel18(spark, d):
    return _panel(spark, d, panels.PANEL18)


@query("panel22", _panel_sql(panels.PANEL22))
def panel22(spark, d):
    return _panel(spark, d, panels.PANEL22)


@query("time_of_window", f"with {v.SWAPS}, e as (select mint, max(t) e, min(t) s from swaps_v group by mint), a as (select mint, greatest(least((e - 86400 * mint - s) / {20 * DAY}, 1), 0) x from e) select mint, round(x, 6) age_norm, round(sin(2 * pi() * x), 6) phase_sin, round(cos(2 * pi() * x), 6) phase_cos from a")
def time_of_window(spark, d):
    ends = v.swaps(spark, d).groupBy("mint").agg(F.max("t").alias("e"), F.min("t").alias("s"))
    return rounded(ends.select("mint", *[c.alias(n) for n, c in panels.time_of_window(F.col("e") - 86400 * F.col("mint"), F.col("s"), 20.0 * DAY).items()]), 6, "age_norm", "phase_sin", "phase_cos")


@query("tick_distribution", f"""with {v.SWAPS}, r as (select * from (select *, max(t) over (partition by mint) e from swaps_v) where e - t <= {3 * DAY}), q as (select *, t - lag(t) over (partition by mint order by t) gap, avg(volume) over (partition by mint) m, stddev_pop(volume) over (partition by mint) s from r),
  a as (select mint, count(*) n, quantile_cont(volume, 0.9) p90, greatest(least(avg(pow(volume - m, 3)) / pow(any_value(s), 3), 10), -10) skew, coalesce(quantile_cont(gap, 0.1) filter (gap > 0), 0) g10, coalesce(quantile_cont(gap, 0.9) filter (gap > 0), 0) g90, count(distinct trader)::double traders from q group by mint)
  select mint, round(case when n >= 3 then p90 else 0 end, 6) size_p90, round(case when n >= 3 then skew else 0 end, 6) size_skew, round(case when n >= 3 then g10 else 0 end, 4) gap_p10, round(case when n >= 3 then g90 else 0 end, 4) gap_p90, case when n >= 3 then traders else 0 end traders from a""")
def tick_distribution(spark, d):
    return rounded(rounded(panels.ticks(v.swaps(spark, d), 3.0 * DAY), 6, "size_p90", "size_skew"), 4, "gap_p10", "gap_p90")


@query("flow_micro", f"""with {v.SWAPS}, g as (select mint, min(t) + {WAIT} g from swaps_v group by mint), w as (select s.*, t - g age from swaps_v s join g using (mint) where t - g >= 0 and t - g < {10 * DAY}),
  b as (select mint, trader, sum(volume) v, min(floor(age / {2 * DAY})) k from w where is_buy = 1 group by all), s as (select *, v / sum(v) over (partition by mint) s from b), h as (select mint, sum(s * s) hhi, max(s) top1, count(*) filter (k < 2) early, count(*) filter (k >= 2) late from s group by mint),
  o as (select mint, count(*) n, count(distinct trader) filter (is_buy = 1) buyers, count(distinct trader) filter (is_buy = 0) sellers, coalesce(sum(case when is_buy = 1 then volume else -volume end) filter (age >= {8 * DAY}) / nullif(sum(volume) filter (age >= {8 * DAY}), 0), 0) imb from w group by mint)
  select mint, buyers, round(coalesce(hhi, 1), 6) buyer_hhi, round(coalesce(top1, 1), 6) top1_share, round(imb, 6) late_imbalance, round(coalesce(late, 0) / greatest(coalesce(early, 0), 1), 6) growth, round(sellers / greatest(buyers, 1), 6) sellers_per_buyer from o left join h using (mint) where n >= 5""")
def flow_micro(spark, d):
    tape = v.swaps(spark, d)
    return rounded(panels.flow_micro(tape, starts(tape), 10 * DAY, 2 * DAY, 2 * DAY), 6, "buyer_hhi", "top1_share", "late_imbalance", "growth", "sellers_per_buyer")


@query("hawkes", f"""with {v.SWAPS}, r as (select *, max(t) over (partition by mint) - t age from swaps_v), s as (select mint, coalesce(sum(exp(-age / {HOUR}.0)) filter (is_buy = 1), 0) b, coalesce(sum(exp(-age / {HOUR}.0)) filter (is_buy = 0), 0) s from r where age <= {DAY} group by mint),
  f as (select mint, is_buy, (select count(*) from r y where y.mint = x.mint and y.is_buy = x.is_buy and y.age <= {2 * DAY} and y.t > x.t and y.t <= x.t + {2 * DAY}) f from r x where age <= {2 * DAY}),
  b as (select mint, case when count(*) filter (is_buy = 1) > 1 then avg(f) filter (is_buy = 1) end bb, case when count(*) filter (is_buy = 0) > 1 then avg(f) filter (is_buy = 0) end bs from f group by mint)
  select mint, round(b, 6) buy_intensity, round(s, 6) sell_intensity, round(coalesce(b / nullif(b + s, 0), 0.5), 6) buy_share, round(coalesce(bb, 0), 6) branching_buy, round(coalesce(bs, 0), 6) branching_sell from s left join b using (mint)""")
def hawkes(spark, d):
    return rounded(panels.hawkes(v.swaps(spark, d), DAY, HOUR, 2.0 * DAY), 6, "buy_intensity", "sell_intensity", "buy_share", "branching_buy", "branching_sell")
