"""Queries on bar patterns, bar features, event scans and safety rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters, patterns, tape
from ..sources import views as v
from .bars import CLEAN, HALF_DAY, clean
from .market import rounded
from .registry import query

ENTRY = 10 * HALF_DAY

OFFSETS = v.SWAPS + f""", hb as (select mint, (floor(t / {HALF_DAY}) * {HALF_DAY})::bigint bar_start, arg_min(price, t) o, max(price) h, min(price) l, arg_max(price, t) c, sum(volume) vol, count(*) n from swaps_v group by all),
  ob as (select *, bar_start - min(bar_start) over (partition by mint) off from hb), e0 as (select *, first_value(o) over (partition by mint order by off) fo, arg_min(o, off) filter (off >= {ENTRY}) over (partition by mint) ep, count(*) over (partition by mint) post from ob)"""


def _entered(bound: str) -> str:
    return OFFSETS + f""", e1 as (select *, row_number() over (partition by mint order by off) - 1 i, count(*) over (partition by mint) n2 from e0 where off {bound} {ENTRY}),
  e2 as (select mint, i, n2 n, vol, c / fo - 1 cr, h / fo - 1 hr, l / fo - 1 lr, ep / fo - 1 er from e1 where post >= 3 and n2 >= 3 and fo > 0 and ep > 0),
  x as (select mint, max(n) n, max(hr) peak, min(lr) trough, arg_min(i, (-hr, i)) pa, arg_min(i, (lr, i)) ta, max(er) entry, max(cr) filter (i = n - 1) last, max(cr) filter (i = n - 3) third, max(cr) filter (i = n - greatest(2, floor(n * 0.3)::bigint)) tf, sum(vol) filter (i < 3) ev, sum(vol) filter (i >= n - 3) lv from e2 group by mint),
  y as (select *, peak - trough rg, last - peak fall, case when peak - trough > 0.01 then (last - trough) / (peak - trough) else 0 end rec from x),
  z as (select *, peak >= 0.1 and trough < peak - 0.1 and rec >= 0.3 and pa < ta vs, entry > 0.1 and fall > -0.1 st from y), zz as (select *, not vs and not st and fall > -0.2 and entry > 0 and peak >= 0.05 nr from z)"""


def offsets(spark, d):
    b = tape.bars(v.swaps(spark, d), HALF_DAY, 7200)
    return b.withColumn("offset", F.col("bar_start") - F.min("bar_start").over(Window.partitionBy("mint")))


@query("pattern_detect", f"with {_entered('<=')} select mint, case when vs then 'vshape' when st then 'steady' when nr then 'near' else 'none' end pattern, round(entry, 6) entry_ret, round(trough, 6) trough_ret, round(rec, 6) recovery from zz")
def pattern_detect(spark, d):
    return rounded(patterns.pattern(offsets(spark, d), ENTRY), 6, "entry_ret", "trough_ret", "recovery")


@query("pattern_detect7", f"""with recursive {_entered('<')}, s as (select mint, i, 0.0::double hi, false held, 0 bumps from e2 where i = 0 union all
    select e.mint, e.i, case when cr > hi + 0.05 then cr else hi end, case when held then not cr < hi - 0.03 else cr > hi + 0.05 end, bumps + (held and cr > hi + 0.05)::int from s join e2 e on e.mint = s.mint and e.i = s.i + 1), bm as (select mint, max(bumps) bumps from s group by mint),
  vr as (select e2.mint, sum(vol) filter (i <= ta) pre, sum(vol) filter (i > ta) post from e2 join zz using (mint) group by e2.mint),
  f as (select zz.*, not vs and not st and not nr and ta < pa and entry > 0.15 and case when rg > 0.01 then (entry - trough) / rg else 0 end > 0.5 and peak >= 0.1 rv, n >= 5 and ta > 0 and ta < n - 2 and trough >= -0.3 and trough < -0.05 and last - tf >= 0.1 and (pa >= ta or peak < 0.1) cup,
    n >= 4 and bumps >= 2 stair, n >= 6 and ev > 0 and lv / ev >= 2 and last > -0.1 swell, case when ta > 0 and ta < n - 1 and pre > 0 then post / pre else 0 end ratio from zz join bm using (mint) join vr using (mint))
  select mint, vs::int vshape, st::int steady, nr::int near, rv::int reversal, cup::int cup_handle, stair::int stair_step, swell::int volume_acceleration, (vs or st or nr or rv or cup or stair or swell)::int any_pattern, round(peak, 6) peak_ret, round(trough, 6) trough_ret, round(entry, 6) entry_ret,
    round(rec, 6) recovery, round(fall, 6) drawdown, round(ratio, 6) volume_ratio, round(last - third, 6) momentum from f""")
def pattern_detect7(spark, d):
    return rounded(patterns.patterns7(offsets(spark, d), ENTRY), 6, "peak_ret", "trough_ret", "entry_ret", "recovery", "drawdown", "volume_ratio", "momentum")


PANEL20 = CLEAN + """, p as (select mint, bar i, high h, low l, close c, volume v, trades n, close / nullif(lag(close) over (partition by mint order by bar), 0) - 1 r, count(*) over (partition by mint) k from clean),
  a as (select mint, max(c) filter (i = 0) c0, max(c) filter (i = k - 3) l0, max(c) filter (i = k - 1) cl, max(h) filter (i = k - 1) hl, max(l) filter (i = k - 1) ll, max(v) filter (i = k - 3) v0, max(v) filter (i = k - 1) vl, max(h) filter (i >= k - 3) lh, min(l) filter (i >= k - 3) lw, max(c) filter (i >= k - 3) mx, min(c) filter (i >= k - 3) mn,
    sum(v) filter (i >= k - 3) lv, sum(n) filter (i >= k - 3)::double lt, stddev_pop(r) filter (i >= k - 2) rs, max(r) filter (i >= k - 2) rx, min(r) filter (i >= k - 2) rn, min(l) lo, max(h) hi, sum(v) v, sum(n)::double tr from p group by mint)"""
COLUMNS20 = {
    "lookback_return": "cl / l0 - 1", "lookback_high_low": "(lh - lw) / l0", "lookback_max_close": "(mx - l0) / l0", "lookback_min_close": "(mn - l0) / l0", "last_bar_range": "(hl - ll) / cl", "lookback_volume": "lv", "lookback_avg_volume": "lv / 3",
    "lookback_volume_slope": "vl - v0", "lookback_volume_acceleration": "vl / greatest(v0, 1)", "lookback_trades": "lt", "lookback_avg_trades": "lt / 3", "lookback_avg_trade_size": "lv / greatest(lt, 1)", "lookback_return_std": "coalesce(rs, 0)",
    "lookback_return_max": "rx", "lookback_return_min": "rn", "cum_return": "cl / c0 - 1", "cum_drawdown": "lo / c0 - 1", "cum_max": "hi / c0 - 1", "cum_volume": "v", "cum_trades": "tr",
}


@query("bar_panel20", f"with {PANEL20} select mint, " + ", ".join(f"round({x}, 6) {n}" for n, x in COLUMNS20.items()) + " from a")
def bar_panel20(spark, d):
    return rounded(patterns.bar_panel20(clean(spark, d).withColumn("i", F.col("bar"))), 6, *COLUMNS20)


@query("bar_panel6", f"""with {CLEAN}, p as (select *, close / nullif(lag(close) over (partition by mint order by bar), 0) - 1 r from clean where bar < 5)
  select mint, round(max(close) filter (bar = 4) / max(close) filter (bar = 0) - 1, 6) as return, round(sum(volume), 4) volume, sum(trades)::double trades, round(coalesce(sum(buys) / nullif(sum(buys + sells), 0), 0.5), 6) buy_share, round(coalesce(stddev_pop(r), 0), 6) volatility, count(*) filter (trades = 0) / 5 stale from p group by mint""")
def bar_panel6(spark, d):
    return rounded(rounded(patterns.legacy6(clean(spark, d).withColumn("i", F.col("bar"))), 6, "return", "buy_share", "volatility"), 4, "volume")


@query("cross_validated", f"with {OFFSETS}, a as (select mint, arg_max(c, off) / arg_min(c, off) - 1 ret from ob where off < {ENTRY} group by mint), b as (select mint, arg_max(o, off) / arg_min(o, off) - 1 other from ob where off < {ENTRY} and mint % 3 <> 0 group by mint) select mint, round(ret, 6) ret, round(other, 6) other, coalesce(abs(ret - other) <= 0.2, true) accepted from a left join b using (mint)")
def cross_validated(spark, d):
    b = offsets(spark, d).where(F.col("offset") < ENTRY)
    ret = lambda rows, c: rows.groupBy("mint").agg((F.max_by(c, "offset") / F.min_by(c, "offset") - 1).alias("ret"))
    return rounded(patterns.cross_validated(ret(b, "close"), ret(b.where("mint % 3 <> 0"), "open"), 0.2), 6, "ret", "other")


@query("feature_route", f"with {CLEAN}, mine as (select mint, max(close) filter (bar = 4) / max(close) filter (bar = 0) - 1 r from clean where not shifted group by mint), all_m as (select distinct mint from swaps_v), fb as (select mint, max(price) / min(price) - 1 r from swaps_v where mint <> 6 group by mint) select mint, case when mine.r is not null then 'bars' when fb.r is not null then 'fallback' else 'none' end route, round(coalesce(mine.r, fb.r), 6) as return from all_m left join mine using (mint) left join fb using (mint)")
def feature_route(spark, d):
    """The features of a mint's own bars if it has enough unmoved ones, else those of the fallback, else null."""
    mints = v.swaps(spark, d)
    own = patterns.legacy6(clean(spark, d).where("not shifted").withColumn("i", F.col("bar"))).select("mint", F.col("return").alias("own"))
    other = mints.where("mint <> 6").groupBy("mint").agg((F.max("price") / F.min("price") - 1).alias("other"))
    rows = mints.select("mint").distinct().join(own, "mint", "left").join(other, "mint", "left")
    route = F.when(F.col("own").isNotNull(), "bars").when(F.col("other").isNotNull(), "fallback").otherwise("none")
    return rows.select("mint", route.alias("route"), F.round(F.coalesce("own", "other"), 6).alias("return"))


@query("winner_label", f"with {OFFSETS}, r as (select *, row_number() over (partition by mint order by off) i, count(*) over (partition by mint) k from ob), e as (select mint, min(i) e from r where off >= 90 group by mint), a as (select mint, max(o) filter (i = e) ep, max(c) filter (i = least(k, e + 3)) xp from r left join e using (mint) group by mint) select mint, case when ep > 0 and xp > 0 then (xp / ep - 1 > 0.0514)::int end winner from a")
def winner_label(spark, d):
    return patterns.winner(offsets(spark, d), 90, 3, 0.0514)


@query("extremes_at", f"with {OFFSETS}, r as (select mint, row_number() over (partition by mint order by off) - 1 i, h, l, vol, count(*) over (partition by mint) k from ob) select mint, arg_min(i, (-h, i)) peak_at, arg_min(i, (l, i)) trough_at, round(sum(vol) filter (i < 3), 4) head_volume, round(sum(vol) filter (i >= k - 3), 4) tail_volume from r group by mint")
def extremes_at(spark, d):
    """First positions of the highest high and the lowest low, and the volumes of the first and last three bars."""
    at = Window.partitionBy("mint")
    r = offsets(spark, d).withColumns({"i": (F.row_number().over(at.orderBy("offset")) - 1).cast("long"), "k": F.count("*").over(at)})
    return r.groupBy("mint").agg(
        F.min_by("i", F.struct(-F.col("high"), F.col("i"))).alias("peak_at"), F.min_by("i", F.struct("low", "i")).alias("trough_at"), F.round(F.sum(F.when(F.col("i") < 3, F.col("volume"))), 4).alias("head_volume"),
        F.round(F.sum(F.when(F.col("i") >= F.col("k") - 3, F.col("volume"))), 4).alias("tail_volume"),
    )


@query("local_maxima", f"with {OFFSETS}, r as (select *, lag(c) over (partition by mint order by off) a, lead(c) over (partition by mint order by off) b from ob) select mint, count(*) filter (c > a and c > b) maxima, round(max(c) filter (c > a and c > b), 6) highest from r group by mint")
def local_maxima(spark, d):
    at = Window.partitionBy("mint").orderBy("offset")
    r = offsets(spark, d).withColumns({"a": F.lag("close").over(at), "b": F.lead("close").over(at)})
    top = (F.col("close") > F.col("a")) & (F.col("close") > F.col("b"))
    return r.groupBy("mint").agg(F.count_if(top).alias("maxima"), F.round(F.max(F.when(top, F.col("close"))), 6).alias("highest"))


@query("stair_step", f"with recursive {_entered('<')}, s as (select mint, i, 0.0::double hi, false held, 0 bumps from e2 where i = 0 union all select e.mint, e.i, case when cr > hi + 0.05 then cr else hi end, case when held then not cr < hi - 0.03 else cr > hi + 0.05 end, bumps + (held and cr > hi + 0.05)::int from s join e2 e on e.mint = s.mint and e.i = s.i + 1) select mint, max(bumps) bumps from s group by mint")
def stair_step(spark, d):
    rows = patterns.entries(offsets(spark, d), ENTRY, inclusive=False).groupBy("mint").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("closes"))
    return rows.select("mint", patterns.stair_bumps(F.col("closes")).alias("bumps"))


DELAYS, SPAN = 10, 2 * 86_400
THRESHOLDS = [("ofi", "absorption", "high", 0.15), ("sell_share", "absorption", "low", 0.45), ("traders", "breadth", "high", 8.0), ("top_share", "breadth", "low", 0.05), ("rise", "persistence", "high", 0.0), ("unknown", "persistence", "high", 1.0)]


@query("event_scan", f"""with {v.SWAPS}, g as (select mint, min(t) g from swaps_v group by mint), w as (select s.*, greatest(ceil((t - g) / {SPAN}), 1)::bigint k from swaps_v s join g using (mint)), dl as (select unnest(range(1, {DELAYS + 1})) delay),
  f as (select mint, delay, sum(case when is_buy = 1 then volume else -volume end) / sum(volume) ofi, count(*) filter (is_buy = 0) / count(*) sell_share, count(*)::double traders, max(volume) / sum(volume) top_share from w join dl on k <= delay group by all),
  p as (select mint, delay, (ofi >= 0.15)::int + (sell_share <= 0.45)::int a, (traders >= 8)::int + (top_share <= 0.05)::int b from f) select mint, min(delay) delay from p where a / 2 >= 0.6 and b / 2 >= 0.6 group by mint""")
def event_scan(spark, d):
    """The first delay (in spans of two days) at which absorption and breadth hold, over all swaps until then."""
    t = v.swaps(spark, d)
    begin = t.groupBy("mint").agg(F.min("t").alias("g"))
    w = t.join(begin, "mint").withColumn("k", F.greatest(F.ceil((F.col("t") - F.col("g")) / SPAN), F.lit(1)))
    side = F.when(F.col("is_buy") == 1, F.col("volume")).otherwise(-F.col("volume"))
    by = w.groupBy("mint", "k").agg(F.sum(side).alias("net"), F.sum("volume").alias("vol"), F.count("*").alias("n"), F.count_if(F.col("is_buy") == 0).alias("sells"), F.max("volume").alias("top"))
    # each mint's few periods, empty ones too, summed up to every delay
    grid = begin.select("mint", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(DELAYS).cast("long"))).alias("k"))
    far = Window.partitionBy("mint").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    run = grid.join(by, ["mint", "k"], "left").select("mint", F.col("k").alias("delay"), *[F.sum(c).over(far).alias(c) for c in ("net", "vol", "n", "sells")], F.max("top").over(far).alias("top"))
    features = run.select("mint", "delay", (F.col("net") / F.col("vol")).alias("ofi"), (F.col("sells") / F.col("n")).alias("sell_share"), F.col("n").cast("double").alias("traders"), (F.col("top") / F.col("vol")).alias("top_share"))
    table = spark.createDataFrame(THRESHOLDS, "feature string, family string, orientation string, threshold double")
    return patterns.event_scan(features, table, {"absorption": 2, "breadth": 2}, ["absorption", "breadth"])


PROFILES = [("vshape", 0.30, 15.0, -0.15, 0.35, -0.20), ("big_winner", 0.60, 40.0, -0.40, 0.60, -0.40)]


@query("safety_rules", f"""with {PANEL20}, q(profile, m5, mv, mr, md, ml) as (values ('vshape', 0.30, 15.0, -0.15, 0.35, -0.20), ('big_winner', 0.60, 40.0, -0.40, 0.60, -0.40)), r as (select mint, profile, case when c0 is null then 'insufficient_kline' when tr < 5 or v < 100 then 'low_activity' when cl / c0 - 1 > m5 then 'return' when v / 100 > mv then 'volume_to_liquidity'
   when cl / c0 - 1 < mr then 'crash' when abs(lo / c0 - 1) > md then 'drawdown' when cl / l0 - 1 < ml then 'freefall' end reason from (select distinct mint from swaps_v) left join a using (mint), q) select mint, profile, reason, reason is null passes from r""")
def safety_rules(spark, d):
    """Reject rules in order for two profiles of thresholds; the first that fails is the reason, mints without bars have one of their own."""
    mints = v.swaps(spark, d).select("mint").distinct()
    panel = patterns.bar_panel20(clean(spark, d).withColumn("i", F.col("bar"))).withColumn("known", F.lit(True))
    table = spark.createDataFrame(PROFILES, "profile string, most_return double, most_volume double, least_return double, most_fall double, least_look double")
    rules = [
        ("insufficient_kline", F.col("known").isNull()), ("low_activity", (F.col("cum_trades") < 5) | (F.col("cum_volume") < 100)), ("return", F.col("cum_return") > F.col("most_return")), ("volume_to_liquidity", F.col("cum_volume") / 100 > F.col("most_volume")),
        ("crash", F.col("cum_return") < F.col("least_return")), ("drawdown", F.abs("cum_drawdown") > F.col("most_fall")), ("freefall", F.col("lookback_return") < F.col("least_look")),
    ]
    rows = mints.join(panel, "mint", "left").join(F.broadcast(table)).withColumn("reason", filters.first_breach(rules))  # two profiles
    return rows.select("mint", "profile", "reason", F.col("reason").isNull().alias("passes"))


@query("threshold_sides", "select p_partkey, case when p_partkey % 3 = 0 then p_retailprice >= 1400 when p_partkey % 3 = 1 and p_size > 5 then p_retailprice <= 1400 end passes from part")
def threshold_sides(spark, d):
    """High and low thresholds; null where the value is not finite or the side unknown."""
    side = F.when(F.col("p_partkey") % 3 == 0, "high").when(F.col("p_partkey") % 3 == 1, "low").otherwise("none")
    value = F.when((F.col("p_partkey") % 3 == 1) & (F.col("p_size") <= 5), float("nan")).otherwise(F.col("p_retailprice"))
    return v.table(spark, d, "part").select("p_partkey", patterns.passes(value, side, F.lit(1400.0)).alias("passes"))
