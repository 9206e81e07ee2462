"""Event states with running distinct traders, swaps netted from balances, fresh prices, a patched table."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import balances, patterns, tape
from ..sinks import layout, versioned
from ..sources import views as v
from ..sources.shared import shared_folder
from .market import rounded
from .patterns import DELAYS, SPAN
from .registry import query

#: Feature, family, orientation, threshold; `hold` is absent while a mint has fewer than LEAST swaps.
LIMITS = [
    ("ofi", "absorption", "high", 0.15), ("sell_share", "absorption", "low", 0.45), ("traders", "breadth", "high", 8.0), ("top_share", "breadth", "low", 0.1),
    ("active", "persistence", "high", 0.9), ("hold", "persistence", "high", 0.9),
]
NEED, LEAST = {"absorption": 2, "breadth": 2, "persistence": 1}, 40

EVENTS = f"""{v.SWAPS},
  g as (select mint, min(t) g from swaps_v group by mint),
  w as (select s.*, greatest(ceil((t - g) / {SPAN}), 1)::bigint k from swaps_v s join g using (mint)),
  dl as (select unnest(range(1, {DELAYS + 1})) delay),
  f as (
    select mint, delay, sum(case when is_buy = 1 then volume else -volume end) / sum(volume) ofi, count(*) filter (is_buy = 0) / count(*) sell_share, count(distinct trader)::double traders,
      max(volume) / sum(volume) top_share, count(distinct k) / delay active, case when count(*) >= {LEAST} then arg_max(price, t) / arg_min(price, t) end hold
    from w join dl on k <= delay group by mint, delay),
  p as (
    select mint, delay, ((ofi >= 0.15)::int + (sell_share <= 0.45)::int) / 2 a, ((traders >= 8)::int + (top_share <= 0.1)::int) / 2 b,
      ((active >= 0.9)::int + coalesce((hold >= 0.9)::int, 0)) / (1 + (hold is not null)::int) c from f),
  s as (select *, a >= 0.6 absorption, b >= 0.6 breadth, c >= 0.6 persistence from p)"""


def _features(spark, d):
    """Of each mint and delay, in spans of two days, features of all swaps until then. Traders count once, at the span of their first swap."""
    t = v.swaps(spark, d)
    begin = t.groupBy("mint").agg(F.min("t").alias("g"))
    w = t.join(begin, "mint").withColumn("k", F.greatest(F.ceil((F.col("t") - F.col("g")) / SPAN), F.lit(1)))
    side = F.when(F.col("is_buy") == 1, F.col("volume")).otherwise(-F.col("volume"))
    by = w.groupBy("mint", "k").agg(
        F.sum(side).alias("net"), F.sum("volume").alias("vol"), F.count("*").alias("n"), F.count_if(F.col("is_buy") == 0).alias("sells"), F.max("volume").alias("top"), F.min_by("price", "t").alias("first"), F.max_by("price", "t").alias("last"), F.lit(1).alias("some")
    )
    new = w.groupBy("mint", "trader").agg(F.min("k").alias("k")).groupBy("mint", "k").agg(F.count("*").alias("new"))
    grid = begin.select("mint", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(DELAYS).cast("long"))).alias("k"))
    far = Window.partitionBy("mint").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(by, ["mint", "k"], "left").join(new, ["mint", "k"], "left")
    run = rows.select("mint", F.col("k").alias("delay"), *[F.sum(c).over(far).alias(c) for c in ("net", "vol", "n", "sells", "new", "some")], F.max("top").over(far).alias("top"), F.first("first", True).over(far).alias("first"), F.last("last", True).over(far).alias("last"))
    return run.select(
        "mint", "delay", (F.col("net") / F.col("vol")).alias("ofi"), (F.col("sells") / F.col("n")).alias("sell_share"), F.col("new").cast("double").alias("traders"), (F.col("top") / F.col("vol")).alias("top_share"), (F.col("some") / F.col("delay")).alias("active"),
        F.when(F.col("n") >= LEAST, F.col("last") / F.col("first")).alias("hold"),
    )


def _states(spark, d):
    limits = spark.createDataFrame(LIMITS, "feature string, family string, orientation string, threshold double")
    return patterns.event_states(_features(spark, d), limits, NEED)


@query("event_states", f"with {EVENTS} select mint, delay, a absorption_share, b breadth_share, c persistence_share, absorption, breadth, persistence from s")
def event_states(spark, d):
    """Which families pass at each delay; a feature that is not there yet counts neither way."""
    return _states(spark, d)


@query(
    "first_events",
    f"""with {EVENTS}, e as (select * from s where absorption and breadth)
  select mint, min(delay) delay, arg_min(a, delay) absorption_share, arg_min(b, delay) breadth_share, arg_min(c, delay) persistence_share, arg_min(persistence, delay) with_persistence from e group by mint""",
)
def first_events(spark, d):
    """The first delay at which absorption and breadth hold, and whether persistence holds then too."""
    return patterns.first_event(_states(spark, d), ["absorption", "breadth"], "persistence")


#: Lines that a task of netted_swaps gets.
LINES = 500_000

LEGS = """legs as (
    select l_orderkey tx, l_linenumber account, case when l_suppkey % 3 = 0 then 'quote' when l_suppkey % 7 = 1 then 'other' else 'base' end mint,
      case when l_linenumber <= 3 then 'C' || o_custkey when l_linenumber <= 5 then 'pool' else 'S' || (l_suppkey % 5) end owner,
      case when l_linenumber % 4 <> 0 then l_quantity end pre, case when l_linenumber % 6 <> 0 then l_quantity + case l_returnflag when 'A' then 1 when 'R' then -1 else 2 end * round(l_tax * 100) end post,
      l_discount, l_returnflag, o_custkey, o_orderstatus, o_orderdate from lineitem join orders on o_orderkey = l_orderkey),
  tx as (select o_orderkey tx, 'base' base, 'C' || o_custkey signer, o_orderstatus = 'P' failed, case when o_orderkey % 11 > 0 then epoch(o_orderdate) end t from orders)"""


@query(
    "netted_swaps",
    f"""with {LEGS},
  n as (select tx, case when l_returnflag = 'R' then -1 else 1 end * round(l_discount * 100) * 50000000::bigint move from legs),
  c as (select tx, mint, owner, sum(coalesce(post, 0) - coalesce(pre, 0)) delta from legs where coalesce(post, 0) - coalesce(pre, 0) <> 0 group by all),
  k as (
    select c.tx, signer, t, sum(delta) filter (mint = 'base' and owner = signer) signed, arg_max(delta, (abs(delta), owner)) filter (mint = 'base') top,
      greatest(sum(case when mint = 'quote' and delta > 0 then delta else 0 end), sum(case when mint = 'quote' and delta < 0 then -delta else 0 end)) token,
      sum(delta) filter (mint = 'quote' and owner = signer) paid from c join tx using (tx) where not failed and t is not null group by all),
  m as (select tx, greatest(sum(case when move > 100000 then move else 0 end), sum(case when move < -100000 then -move else 0 end)) coins from n group by tx),
  r as (select k.*, greatest(token, coalesce(coins, 0) / 1e9) quote_amount, case when signed is not null and abs(signed) >= 1e-12 then signed else -top end d from k left join m using (tx))
  select tx, 'base' mint, signer trader, (d > 0)::int is_buy, abs(d) base_amount, quote_amount, round(quote_amount / abs(d), 9) price, t::bigint t from r
  where d <> 0 and quote_amount > 0 and (paid is null or abs(paid) <= 0.01 * quote_amount or sign(paid) <> sign(d))""",
)
def netted_swaps(spark, d):
    """Orders as transactions, their lines as balance changes of the signer, a pool and others: one to many legs.

    The lines are dealt by order once, so many at a time that a task's sorts and sums are of LINES lines, however many there are.
    """
    line, signer = F.col("l_linenumber"), F.concat(F.lit("C"), F.col("o_custkey"))
    lines = v.table(spark, d, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES + 1)
    lines, o = lines.repartition(tasks, "l_orderkey"), v.table(spark, d, "orders").repartition(tasks, "o_orderkey")
    rows = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    way = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(2)
    legs = rows.select(
        F.col("l_orderkey").alias("tx"), line.alias("account"), F.when(F.col("l_suppkey") % 3 == 0, "quote").when(F.col("l_suppkey") % 7 == 1, "other").otherwise("base").alias("mint"),
        F.when(line <= 3, signer).when(line <= 5, "pool").otherwise(F.concat(F.lit("S"), F.col("l_suppkey") % 5)).alias("owner"),
        F.when(line % 4 != 0, F.col("l_quantity")).alias("pre"), F.when(line % 6 != 0, F.col("l_quantity") + way * F.round(F.col("l_tax") * 100)).alias("post"),
    )
    move = F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.round(F.col("l_discount") * 100).cast("long") * 50_000_000
    natives = lines.select(F.col("l_orderkey").alias("tx"), line.alias("account"), F.lit(0).cast("long").alias("pre"), move.alias("post"))
    seconds = F.floor(v.epoch("o_orderdate"))
    transactions = o.select(F.col("o_orderkey").alias("tx"), F.lit("base").alias("base"), signer.alias("signer"), (F.col("o_orderstatus") == "P").alias("failed"), F.when(F.col("o_orderkey") % 11 > 0, seconds).alias("t"))
    return rounded(balances.swaps(transactions, legs, natives, "quote"), 9, "price")


DAY = 86_400


@query("fresh_median", f"with {v.SWAPS}, n as (select max(t) now from swaps_v), r as (select s.* from swaps_v s, n where t >= now - {DAY} qualify row_number() over (partition by mint order by t desc) <= 7) select mint, round(median(price), 6) median_price from r group by mint")
def fresh_median(spark, d):
    """The median of a mint's last seven prices of the last day, by the newest time of all."""
    t = v.swaps(spark, d)
    now = t.agg(F.max("t").alias("now"))  # one row
    return rounded(tape.fresh_median(t.join(F.broadcast(now)), F.col("now"), DAY), 6, "median_price")


@query(
    "peak_since",
    f"""with {v.SWAPS}, b as (select mint, min(t) + {10 * DAY} since from swaps_v group by mint),
  c as (select a.mint, a.t, a.price, (select count(*) from swaps_v o where o.mint = a.mint and o.t between a.t - 3600 and a.t + 3600 and o.price >= 0.8 * a.price) n from swaps_v a)
  select c.mint, max(price) filter (n >= 3) peak, count(*) swaps from c join b using (mint) where t >= since group by c.mint""",
)
def peak_since(spark, d):
    """The highest confirmed price since ten days after a mint's first swap."""
    t = v.swaps(spark, d)
    since = t.groupBy("mint").agg((F.min("t") + 10 * DAY).alias("since"))
    return tape.peak_since(t.join(F.broadcast(since), "mint"), F.col("since"), 3600)  # ten mints; a join by shuffle would put all swaps into ten tasks


@query(
    "newest_trend",
    f"""with {v.SWAPS}, n as (select s.* from swaps_v s join (select mint, max(t) e from swaps_v group by mint) using (mint) where t >= e - {DAY}),
  r as (select *, row_number() over (partition by mint order by t) a, row_number() over (partition by mint order by t desc) z from n),
  s as (select mint, case when count(*) >= 5 then median(price) filter (z <= 3) / median(price) filter (a <= 3) - 1 end trend from r group by mint)
  select mint, round(trend, 6) trend, case when trend < -0.1 then 'active_dump' when trend > 0.1 then 'pump_top' else 'neutral' end signal from s""",
)
def newest_trend(spark, d):
    return rounded(tape.newest_trend(v.swaps(spark, d), DAY, -0.1, 0.1), 6, "trend")


@query(
    "patched_table",
    """with one as (select l_orderkey k, arg_max(l_quantity, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) q from lineitem where l_linenumber = 1 group by 1),
  two as (select l_orderkey k, arg_max(l_quantity, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) q from lineitem where l_linenumber = 2 group by 1),
  n as (select coalesce(one.k, two.k) k, one.q q1, two.q q2 from one full join two on one.k = two.k)
  select coalesce(o_orderkey, k) order_id, case when q1 is not null then 'SHIPPED' else o_orderstatus end status, o_totalprice amount, coalesce(q2, q1) quantity from orders full join n on k = o_orderkey""",
)
def patched_table(spark, d):
    """Orders are inserted, patched by first shipments, compacted, patched by second ones; every job runs twice."""
    path = f"{shared_folder(spark)}/tapeworks/patched-{uuid.uuid4().hex}"
    none = lambda kind: F.lit(None).cast(kind)
    o, items = v.table(spark, d, "orders"), v.table(spark, d, "lineitem")
    inserted = o.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), none("double").alias("quantity"), none("struct<a:timestamp_ntz,b:bigint,c:bigint,d:double>").alias("at"))
    at = F.struct(F.col("l_shipdate").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"), F.col("l_extendedprice").alias("d")).alias("at")
    shipped = lambda n, status: items.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("order_id"), F.lit(status).cast("string").alias("status"), none("double").alias("amount"), F.col("l_quantity").alias("quantity"), at)
    keys, order = ["order_id"], ["at"]
    jobs = [
        lambda: versioned.patch(inserted, path, "insert"), lambda: versioned.patch(shipped(1, "SHIPPED"), path, "first"), lambda: versioned.compact(spark, path, inserted, keys, order, "compact"), lambda: versioned.patch(shipped(2, None), path, "second"),
    ]
    for job in [*jobs, *jobs]:
        job()
    return versioned.read(spark, path, inserted, keys, order).drop("at")


@query(
    "laid_out_scan",
    f"with {v.SWAPS} select mint, trader, is_buy, volume, price, t from swaps_v where mint = 4 and t between 1704672000 and 1705276800",
)
def laid_out_scan(spark, d):
    """A mint's swaps of a week from a tape that is laid out by mint and time."""
    path = f"{shared_folder(spark)}/tapeworks/laid-out-{uuid.uuid4().hex}"
    layout.lay_out(v.swaps(spark, d), path, ["mint", "t"], 64)
    return layout.scan(spark, path, {"mint": (4, 4), "t": (1704672000.0, 1705276800.0)}).drop("seq")
