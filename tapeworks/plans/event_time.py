"""Streams in event time: the events arrive out of order in several batches, and the results are those of the ordered whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import views as v
from ..streaming import folds
from ..streaming.ordered import arrivals, ordered, run_in_batches
from .market import BARS, HOUR, rounded
from .registry import query

DAY = 24 * HOUR
LATE_MS, LATE, BATCHES = 6 * HOUR * 1000, "6 hours", 3


def _tape(spark, d):
    """Swaps with their number, a row's milliseconds and nothing but columns that a heartbeat may leave null."""
    return v.swaps(spark, d).withColumn("ms", F.floor(F.col("t") * 1000).cast("long"))


def _in_batches(rows, build, number="seq"):
    made, _ = run_in_batches(arrivals(rows, "ms", F.col(number), LATE_MS, BATCHES), build)
    return made


def _in_order(rows, key, ties, fold, schema):
    made = _in_batches(rows, lambda s: ordered(s, key, "ms", LATE, ties, fold, schema), ties[-1])
    return made.where(~F.col("late")).drop("late")


def _bars(spark, d, seconds, tail):
    return _in_batches(_tape(spark, d), lambda s: folds.bars(s, seconds, tail, LATE))


@query("stream_bars", f"with {BARS} select mint, bar_start, open, high, low, close, round(volume, 4) volume, trades, buys, sells, round(vwap_close, 6) vwap_close from b")
def stream_bars(spark, d):
    """Bars that the watermark closes, from swaps that come up to six hours late."""
    rows = _bars(spark, d, HOUR, 600).where(~F.col("late")).drop("late", "buy_volume")
    return rounded(rounded(rows, 4, "volume"), 6, "vwap_close")


@query(
    "stream_vpin",
    f"""with {v.SWAPS}, b as (
    select mint, floor(t / 14400) k, count(*) n, sum(case when is_buy = 1 then volume else 0 end) buy, sum(volume) vol from swaps_v group by all)
  select mint, round(avg(abs(2 * buy - vol) / nullif(vol, 0)), 6) vpin, count(*) buckets from b where n >= 3 group by mint""",
)
def stream_vpin(spark, d):
    return rounded(folds.vpin(_bars(spark, d, 14400, 0), 3), 6, "vpin")


IDLE, EVICT = DAY, 2 * DAY


@query(
    "stream_status",
    f"""with {v.SWAPS}, r as (
    select trader, floor(t * 1000)::bigint ms, price, lag(floor(t * 1000)::bigint) over w before, lead(floor(t * 1000)::bigint) over w next
    from swaps_v window w as (partition by trader order by t)),
  s as (select *, sum(case when before is null or ms - before >= {EVICT * 1000} then 1 else 0 end) over (partition by trader order by ms rows unbounded preceding) life from r),
  n as (select *, row_number() over (partition by trader, life order by ms) as k from s),
  told as (
    select trader, 'running' status, ms at_ms, ms, price, k from n where before is null or ms - before >= {IDLE * 1000}
    union all select trader, 'idle', ms + {IDLE * 1000}, ms, price, k from n where next is null or next - ms >= {IDLE * 1000}
    union all select trader, 'evicted', ms + {EVICT * 1000}, ms, price, k from n where next is null or next - ms >= {EVICT * 1000})
  select trader, status, at_ms, ms last_ms, price last_value, k::bigint as rows from told""",
)
def stream_status(spark, d):
    """When each trader was running, idle and forgotten, told by timers."""
    fold = folds.Liveness("trader", "ms", "price", IDLE, EVICT)
    return _in_order(_tape(spark, d).select("trader", "price", "t", "seq", "ms"), "trader", ["t", "seq"], fold, "trader long, " + fold.schema)


@query(
    "changes_in_order",
    f"""with recursive {v.SWAPS}, r as (select mint, t, price, row_number() over (partition by mint order by t, price) k from swaps_v),
  c as (
    select mint, k, t, price, price as last, true as emit from r where k = 1
    union all
    select r.mint, r.k, r.t, r.price, case when abs(r.price - last) >= 0.3::double * abs(last) then r.price else last end, abs(r.price - last) >= 0.3::double * abs(last)
    from c join r on r.mint = c.mint and r.k = c.k + 1)
  select mint, t, price from c where emit""",
)
def changes_in_order(spark, d):
    fold = folds.Emitted("mint", "ms", "t", "price", folds.changed(0.3))
    return _in_order(_tape(spark, d).select("mint", "price", "t", "seq", "ms"), "mint", ["t", "price", "seq"], fold, "mint long, t double, price double")


@query(
    "throttled_in_order",
    f"""with recursive {v.SWAPS}, r as (select mint, t, price, row_number() over (partition by mint order by t, price) k from swaps_v),
  c as (
    select mint, k, t, price, t as last, 1 as n, true as emit from r where k = 1
    union all
    select r.mint, r.k, r.t, r.price, case when r.t - last >= {DAY} and n < 5 then r.t else last end, n + (r.t - last >= {DAY} and n < 5)::int, r.t - last >= {DAY} and n < 5
    from c join r on r.mint = c.mint and r.k = c.k + 1)
  select mint, t, price from c where emit""",
)
def throttled_in_order(spark, d):
    """At most one row a day of each mint and five in all, counted in the stream's state."""
    fold = folds.Emitted("mint", "ms", "t", "price", folds.apart(DAY), most=5)
    return _in_order(_tape(spark, d).select("mint", "price", "t", "seq", "ms"), "mint", ["t", "price", "seq"], fold, "mint long, t double, price double")


@query(
    "orders_in_order",
    """with e as (
    select event_id // 8 order_id, event_id seq, ts, value, 1 + (event_id * 7919 % 1000) / 1000 price,
      case when event_id % 8 = 1 then 'created' when event_type = 'error' and event_id % 5 = 0 then 'failed' when event_type = 'signup' and event_id % 3 = 0 then 'cancelled' else 'filled' end kind from events),
  born as (select order_id, min(ts) ts, max(value) * 3 amount from e where kind = 'created' group by order_id),
  f as (select e.* from e join born using (order_id) where kind = 'filled' and e.ts >= born.ts),
  s as (
    select born.order_id, any_value(born.amount) amount, count(f.seq) fills, coalesce(sum(f.value), 0) filled, arg_max(f.price, f.ts) last_price, coalesce(sum(f.value * 0.001), 0) fee, max(f.ts) last_ts
    from born left join f using (order_id) group by born.order_id),
  x as (
    select s.order_id, bool_or(kind = 'failed' and (last_ts is null or e.ts > last_ts)) failed, bool_or(kind = 'cancelled' and (last_ts is null or e.ts > last_ts)) cancelled
    from s join e using (order_id) group by s.order_id)
  select order_id, fills, round(filled, 2) filled, round(last_price, 6) last_price, round(fee, 6) fee,
    case when failed then 'FAILED' when cancelled then 'CANCELLED' when filled >= amount then 'FILLED' when fills > 0 then 'PARTIALLY_FILLED' else 'OPEN' end status
  from s join x using (order_id)""",
)
def orders_in_order(spark, d):
    """The newest state of each order of a stream of order events: of eight events one is the creation, the others fills and ends."""
    e, n = v.table(spark, d, "events"), F.col("event_id")
    kind = F.when(n % 8 == 1, "created").when((F.col("event_type") == "error") & (n % 5 == 0), "failed").when((F.col("event_type") == "signup") & (n % 3 == 0), "cancelled").otherwise("filled")
    rows = e.select(
        F.expr("event_id div 8").alias("order_id"), n.alias("seq"), F.floor(v.epoch("ts") * 1000).cast("long").alias("ms"), v.epoch("ts").alias("t"), kind.alias("kind"), (F.col("value") * F.when(kind == "created", 3.0).otherwise(1.0)).alias("amount"),
        (1 + (n * 7919 % 1000) / 1000).alias("price"), (F.col("value") * 0.001).alias("fee"),
    )
    fold = folds.Orders("order_id", "ms", 30 * DAY)
    made = _in_order(rows.withColumn("rank", folds.rank(F.col("kind"))), "order_id", ["t", "rank", "seq"], fold, "order_id long, " + fold.schema)
    last = made.groupBy("order_id").agg(*[F.max_by(c, "version").alias(c) for c in ("fills", "filled", "last_price", "fee", "status")])
    return rounded(rounded(last, 2, "filled"), 6, "last_price", "fee")
