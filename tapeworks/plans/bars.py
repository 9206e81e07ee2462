"""Queries on cleaned bars and on the newest swaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars
from ..sources import views as v
from .market import rounded
from .registry import query

HALF_DAY, COUNT, DUST, OUTLIER, TAIL = 43_200, 6, 20.0, 0.25, 7200

#: Starts: out of the tape for every fourth mint (moved), before the first swap for every fifth (a leading gap), else at the first swap's bar.
STARTS = f"starts as (select mint, (floor(min(t) / {HALF_DAY}) * {HALF_DAY} - case when mint % 4 = 1 then {100 * HALF_DAY} when mint % 5 = 2 then {HALF_DAY} else 0 end)::bigint start from swaps_v group by mint)"

CLEAN = v.SWAPS + f""", {STARTS},
  al as (select mint, case when count(*) filter (t >= start and t < start + {HALF_DAY * COUNT}) = 0 then (floor(min(t) / {HALF_DAY}) * {HALF_DAY})::bigint else start end start, count(*) filter (t >= start and t < start + {HALF_DAY * COUNT}) = 0 shifted from swaps_v join starts using (mint) group by mint, start),
  b0 as (select s.*, al.start, shifted, floor((t - al.start) / {HALF_DAY})::bigint bar from swaps_v s join al using (mint) where floor((t - al.start) / {HALF_DAY}) between 0 and {COUNT - 1}),
  b1 as (select * from b0 qualify volume >= {DUST} or count(*) filter (volume >= {DUST}) over (partition by mint, bar) = 0),
  b2 as (select *, ln(price) lp, sqrt(greatest(volume, 1e-9)) w, count(*) over (partition by mint, bar) n from b1),
  b3 as (select *, sum(w) over (partition by mint, bar order by lp, w rows unbounded preceding) c, sum(w) over (partition by mint, bar) tw from b2),
  b4 as (select *, min(lp) filter (c >= tw / 2) over (partition by mint, bar) med from b3),
  b5 as (select * from b4 where n <= 2 or abs(lp - med) <= {OUTLIER}),
  own as (select mint, bar, arg_min(price, t) o, max(price) h, min(price) l, coalesce(sum(price * volume) filter (t >= start + (bar + 1) * {HALF_DAY} - {TAIL}) / nullif(sum(volume) filter (t >= start + (bar + 1) * {HALF_DAY} - {TAIL}), 0), arg_max(price, t)) c,
    sum(volume) vol, count(*) n, count(*) filter (is_buy = 1) buys, count(*) filter (is_buy = 0) sells from b5 group by mint, bar),
  grid as (select mint, start, shifted, unnest(range({COUNT})) bar from al),
  f as (select g.*, o, h, l, vol, n, buys, sells, last_value(c ignore nulls) over (partition by g.mint order by g.bar) c from grid g left join own using (mint, bar)),
  clean as (select mint, bar, start + bar * {HALF_DAY} bar_start, coalesce(o, c) as open, coalesce(h, c) high, coalesce(l, c) low, c as close, coalesce(vol, 0) volume, coalesce(n, 0) trades, coalesce(buys, 0) buys, coalesce(sells, 0) sells, shifted
    from f where mint not in (select mint from f where bar = 0 and c is null))"""  # fmt: skip


def starts(tape):
    first = F.floor(F.min("t") / HALF_DAY) * HALF_DAY
    s = tape.groupBy("mint").agg(first.alias("start"))
    back = F.when(F.col("mint") % 4 == 1, 100 * HALF_DAY).when(F.col("mint") % 5 == 2, HALF_DAY).otherwise(0)
    return s.withColumn("start", (F.col("start") - back).cast("long"))


def clean(spark, d):
    tape = v.swaps(spark, d)
    return bars.clean_bars(tape, starts(tape), HALF_DAY, COUNT, DUST, OUTLIER, TAIL)


@query("bars_clean", f"with {CLEAN} select mint, bar, bar_start, round(open, 6) as open, round(high, 6) high, round(low, 6) low, round(close, 6) as close, round(volume, 4) volume, trades, buys, sells, shifted from clean")
def bars_clean(spark, d):
    return rounded(rounded(clean(spark, d), 6, "open", "high", "low", "close"), 4, "volume")


@query("bars_alignment", f"with {CLEAN} select mint, start, shifted from al")
def bars_alignment(spark, d):
    tape = v.swaps(spark, d)
    return bars.aligned(tape, starts(tape), HALF_DAY, COUNT)


@query("outliers", f"with {CLEAN}, kept as (select mint, count(*) kept from b5 group by mint) select mint, count(*) swaps, (select count(*) from b1 where b1.mint = b0.mint) large, any_value(kept.kept) kept from b0 join kept using (mint) group by mint")
def outliers(spark, d):
    """Swaps of each mint's bars, those that aren't dust, and those that are no outliers either."""
    tape = v.swaps(spark, d)
    spans = bars.aligned(tape, starts(tape), HALF_DAY, COUNT)
    rows = tape.join(spans, "mint").withColumn("bar", F.floor((F.col("t") - F.col("start")) / HALF_DAY)).where(F.col("bar").between(0, COUNT - 1))
    large = bars.without_dust(rows, ["mint", "bar"], DUST)
    kept = bars.without_outliers(large, ["mint", "bar"], OUTLIER)
    counted = [x.groupBy("mint").agg(F.count("*").alias(n)) for x, n in ((rows, "swaps"), (large, "large"), (kept, "kept"))]
    return counted[0].join(counted[1], "mint").join(counted[2], "mint")


@query("vwmp", f"""with {v.SWAPS}, n as (select max(t) now from swaps_v), a as (select s.*, now - t age from swaps_v s, n), q as (select *, age <= 86400 and volume >= 10 and price > 0 good from a),
  l as (select mint, price, sum(volume) v from q where good group by all), c as (select mint, price, sum(v) over (partition by mint order by price rows unbounded preceding) c, sum(v) over (partition by mint) t from l), p as (select mint, min(price) price from c where c >= t / 2 group by mint),
  s as (select mint, count(*) buffer, count(*) filter (good) qualified, max(age) filter (good) oldest, min(age) filter (good) newest, sum(volume) filter (good) vol, min(price) filter (good) lo, max(price) filter (good) hi from q group by mint)
  select mint, buffer, qualified, round(oldest, 3) oldest_age, round(newest, 3) newest_age, round(vol, 4) volume, lo price_min, hi price_max, case when qualified >= 5 then p.price end price, case when qualified = 0 then 'no_data' when qualified < 5 then 'insufficient_swaps' else 'ok' end status from s left join p using (mint)""")
def vwmp(spark, d):
    tape = v.swaps(spark, d)
    now = F.coalesce(tape.agg(F.max("t")).scalar(), F.lit(0.0))
    return rounded(rounded(bars.median_price(tape, now, 86_400.0, 10.0, 5), 3, "oldest_age", "newest_age"), 4, "volume")


@query("buffer_recent", f"with {v.SWAPS} select mint, count(*) kept, min(t) oldest from (select *, max(t) over (partition by mint) e from swaps_v) where t >= e - 172800 group by mint")
def buffer_recent(spark, d):
    return bars.recent(v.swaps(spark, d), 172_800.0).groupBy("mint").agg(F.count("*").alias("kept"), F.min("t").alias("oldest"))


@query("level_confirmed", f"with {v.SWAPS}, r as (select * from (select *, max(t) over (partition by mint) e from swaps_v) where t >= e - 345600) select mint, count(distinct case when price <= 1.2 then trader end) dip, count(distinct case when price <= 1.2 then trader end) >= 3 dip_confirmed, count(distinct case when price >= 1.8 then trader end) peak, count(distinct case when price >= 1.8 then trader end) >= 3 peak_confirmed from r group by mint")
def level_confirmed(spark, d):
    tape = v.swaps(spark, d)
    dip = bars.level_confirmed(tape, F.lit(1.2), 345_600.0, 3, above=False).select("mint", F.col("traders").alias("dip"), F.col("confirmed").alias("dip_confirmed"))
    peak = bars.level_confirmed(tape, F.lit(1.8), 345_600.0, 3, above=True).select("mint", F.col("traders").alias("peak"), F.col("confirmed").alias("peak_confirmed"))
    return dip.join(peak, "mint")
