"""Queries on streams (run over the events that are there) and on recurrences over bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history, indicators, orders, recurrences, tape
from ..sources import views as v
from ..streaming import streams
from .market import BARS, HOUR, _bars, rounded
from .registry import query

DAY = 24 * HOUR


def _swaps(spark, d):
    return v.swaps_of(streams.read(spark, d, "events"))


@query("stream_dedup", f"with {v.SWAPS} select distinct mint, trader, is_buy, floor(t / {HOUR})::bigint as hour from swaps_v")
def stream_dedup(spark, d):
    """A trader's first swap of a side and hour; keys hold the hour, so none comes back after it is forgotten."""
    rows = _swaps(spark, d).withColumns({"hour": F.floor(F.col("t") / HOUR), "ts": F.timestamp_seconds("t")})
    keys = ["mint", "trader", "is_buy", "hour"]
    return streams.drained(streams.deduplicated(rows, keys, "ts", "2 hours").select(*keys))


@query("stream_liveness", f"""with {v.SWAPS}, e as (select max(t) now from swaps_v), s as (select trader, max(t) last_t, arg_max(price, t) last_value, count(*) as rows from swaps_v group by trader)
  select trader, last_t, last_value, rows, case when now - last_t < {DAY} then 'running' else 'idle' end status, greatest({DAY} - (now - last_t), 0) remaining from s, e""")
def stream_liveness(spark, d):
    seen = streams.drained(streams.last_seen(_swaps(spark, d), "trader", "t", "price"), "update", ["trader"])
    return streams.liveness(seen, F.coalesce(seen.agg(F.max("last_t")).scalar(), F.lit(0.0)), DAY)


@query("stream_changes", f"""with recursive {v.SWAPS}, r as (select mint, t, price, row_number() over (partition by mint order by t, price) k from swaps_v),
  c as (select mint, k, t, price, price as last, true as emit from r where k = 1 union all select r.mint, r.k, r.t, r.price, case when abs(r.price - last) >= 0.3::double * abs(last) then r.price else last end, abs(r.price - last) >= 0.3::double * abs(last) from c join r on r.mint = c.mint and r.k = c.k + 1) select mint, t, price from c where emit""")
def stream_changes(spark, d):
    return streams.drained(streams.changes(_swaps(spark, d), "mint", "t", "price", 0.3))


@query("stream_rate_limited", f"""with recursive {v.SWAPS}, r as (select mint, t, volume, row_number() over (partition by mint order by t, volume) k from swaps_v where is_buy = 0 and volume >= 20),
  c as (select mint, k, t, volume, t as last, true as emit from r where k = 1 union all select r.mint, r.k, r.t, r.volume, case when r.t - last >= {HOUR} then r.t else last end, r.t - last >= {HOUR} from c join r on r.mint = c.mint and r.k = c.k + 1) select mint, t, volume from c where emit""")
def stream_rate_limited(spark, d):
    sells = _swaps(spark, d).where((F.col("is_buy") == 0) & (F.col("volume") >= 20))
    return streams.drained(streams.rate_limited(sells, "mint", "t", "volume", HOUR))


def _ema_sql(name: str, source: str, value: str, first: int, length: int) -> str:
    """A recursive table (mint, i, value, x): the average of `length` values from row `first` on, then the recurrence."""
    at = first + length - 1
    return f"""{name}_s as (select mint, avg({value}) filter (i between {first} and {at}) s from {source} group by mint), {name} as (select r.mint, i, s x from {source} r join {name}_s s on s.mint = r.mint where i = {at}
    union all select r.mint, r.i, e.x + (r.{value} - e.x) * {2 / (length + 1)!r}::double from {name} e join {source} r on r.mint = e.mint and r.i = e.i + 1)"""


MACD = BARS + ", o as (select *, row_number() over (partition by mint order by bar_start) i from b), " + _ema_sql("ef", "o", "close", 1, 12) + ", " + _ema_sql("es", "o", "close", 1, 26) + """,
  ln as (select ef.mint, ef.i, ef.x - es.x line from ef join es on es.mint = ef.mint and es.i = ef.i), """ + _ema_sql("eg", "ln", "line", 26, 9) + ", macd as (select o.*, line, line - eg.x hist from o left join ln on ln.mint = o.mint and ln.i = o.i left join eg on eg.mint = o.mint and eg.i = o.i)"


@query("macd_bands_signal", f"""with recursive {MACD}, w as (select *, count(*) over k n, avg(close) over k mid, 2 * stddev_pop(close) over k dv from macd window k as (partition by mint order by bar_start rows 19 preceding)), z as (select *, case when n = 20 then (close - mid + dv) / nullif(2 * dv, 0) end bbp from w)
  select mint, bar_start, round(bbp, 6) bbp, round(line, 6) macd, round(hist, 6) macd_hist, case when bbp < 0.4 and hist > 0 and line < 0 then 1 when bbp > 0.6 and hist < 0 and line > 0 then -1 else 0 end signal from z""")
def macd_bands_signal(spark, d):
    bars = _bars(spark, d)
    rows = recurrences.macd_bands_signal(indicators.bollinger(bars, 20, 2.0), recurrences.macd(bars, 12, 26, 9), 0.4, 0.6)
    return rounded(rows, 6, "bbp", "macd", "macd_hist")


def _atr_sql(length: int) -> str:
    return BARS + f""", o as (select *, row_number() over (partition by mint order by bar_start) i, coalesce(lag(close) over (partition by mint order by bar_start), close) before from b), tr as (select *, greatest(high - low, abs(high - before), abs(low - before)) tr from o),
  ts as (select mint, avg(tr) filter (i <= {length}) s from tr group by mint), atr as (select r.mint, i, s x from tr r join ts on ts.mint = r.mint where i = {length} union all select r.mint, r.i, {1 / length!r}::double * r.tr + {1 - 1 / length!r}::double * e.x from atr e join tr r on r.mint = e.mint and r.i = e.i + 1)"""


@query("supertrend_signal", f"""with recursive {_atr_sql(20)}, bd as (select tr.mint, tr.i, bar_start, close, (high + low) / 2 + 4 * x up, (high + low) / 2 - 4 * x dn from tr join atr on atr.mint = tr.mint and atr.i = tr.i),
  s as (select mint, i, up, dn, 1 way from bd where i = 20 union all select q.mint, q.i, case when q.way > 0 then q.up else least(q.up, q.pu) end, case when q.way > 0 then greatest(q.dn, q.pd) else q.dn end, q.way
    from (select b.mint, b.i, b.up, b.dn, s.up pu, s.dn pd, case when b.close > s.up then 1 when b.close < s.dn then -1 else s.way end way from s join bd b on b.mint = s.mint and b.i = s.i + 1) q),
  f as (select o.mint, o.bar_start, o.close, coalesce(way, 0) direction, case when way > 0 then dn when way < 0 then up end line from o left join s on s.mint = o.mint and s.i = o.i)
  select mint, bar_start, round(line, 6) line, direction, case when abs(close - line) / close < 0.5 then direction else 0 end signal from f""")
def supertrend_signal(spark, d):
    return rounded(recurrences.supertrend(_bars(spark, d), 20, 4.0, 0.5), 6, "line").select("mint", "bar_start", "line", "direction", "signal")


@query("volatility_shift", f"""with recursive {_atr_sql(14)}, {MACD[len(BARS) :].split("from b), ", 1)[1]},
  z as (select m.*, atr.x / close natr, -(line - avg(line) over (partition by m.mint)) / nullif(stddev_samp(line) over (partition by m.mint), 0) sc from macd m left join atr on atr.mint = m.mint and atr.i = m.i)
  select mint, bar_start, round(natr, 6) natr, round(close * (1 + (0.5 * sc + 0.5 * case when hist > 0 then 1 else -1 end) * natr / 2), 6) reference_price from z""")
def volatility_shift(spark, d):
    return rounded(recurrences.volatility_shift(_bars(spark, d), 14, 12, 26, 9), 6, "natr", "reference_price").select("mint", "bar_start", "natr", "reference_price")


@query("stream_signatures", f"with {v.SWAPS} select mint, count(*) swaps from swaps_v group by mint")
def stream_signatures(spark, d):
    """Every swap comes twice; each signature of a mint counts once."""
    rows = streams.read(spark, d, "events").select((F.col("user_id") % 10).alias("mint"), F.col("event_id").alias("signature"), F.col("ts").cast("timestamp").alias("ts"))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = streams.drained(streams.deduplicated(twice, ["mint", "signature"], "ts", "1 hour").select("mint", "signature"))
    return kept.groupBy("mint").agg(F.count("*").alias("swaps"))


@query("stream_snapshots", f"with {v.SWAPS} select 0::bigint as dump, mint, count(*) swaps, arg_max(price, t) price from swaps_v group by mint")
def stream_snapshots(spark, d):
    """The state of every mint at the end of each micro-batch, under one number for each."""
    return streams.snapshots(_swaps(spark, d), lambda df: df.groupBy("mint").agg(F.count("*").alias("swaps"), F.max_by("price", "t").alias("price")), "dump")


@query("stream_throttled", f"""with recursive {v.SWAPS}, r as (select mint, t, price, row_number() over (partition by mint order by t, price) k from swaps_v),
  c as (select mint, k, t, price, t as last, true as emit from r where k = 1 union all select r.mint, r.k, r.t, r.price, case when r.t - last >= {DAY} then r.t else last end, r.t - last >= {DAY} from c join r on r.mint = c.mint and r.k = c.k + 1) select mint, t, price from c where emit qualify row_number() over (partition by mint order by t) <= 5""")
def stream_throttled(spark, d):
    """At most one row a day of each mint, and five in all."""
    kept = streams.drained(streams.rate_limited(_swaps(spark, d), "mint", "t", "price", DAY))
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("mint").orderBy("t"))).where("r <= 5").drop("r")


@query("stream_routes", "select 'clicks' as handler, count(*) as rows from events where event_type = 'click' union all select 'third', count(*) from events where user_id % 5 = 3")
def stream_routes(spark, d):
    """Handlers by topic pattern, each with a table of its own."""
    rows = streams.read(spark, d, "events").select("event_id", F.concat(F.lit("ns/bot"), (F.col("user_id") % 5).cast("string"), F.lit("/"), "event_type").alias("topic"))
    return streams.routed(rows, "topic", {"clicks": "ns/+/click", "third": "ns/bot3/#"}).groupBy("handler").agg(F.count("*").alias("rows"))


@query("ring_buffers", """with r as (select event_type = 'error' as errors, user_id % 10 as mint, event_id, row_number() over (partition by event_type = 'error', user_id % 10 order by ts desc, event_id desc) k from events) select errors, mint, count(*) held, max(event_id) newest, min(event_id) oldest from r where k <= 20 group by all""")
def ring_buffers(spark, d):
    """The newest 20 messages of each mint, errors apart from the rest."""
    rows = v.table(spark, d, "events").select((F.col("event_type") == "error").alias("errors"), (F.col("user_id") % 10).alias("mint"), "event_id", "ts")
    kept = history.newest_of(rows, ["errors", "mint"], ["ts", "event_id"], 20)
    return kept.groupBy("errors", "mint").agg(F.count("*").alias("held"), F.max("event_id").alias("newest"), F.min("event_id").alias("oldest"))


@query("backfill_gaps", f"with {v.SWAPS}, g as (select mint, t, t - lag(t) over (partition by mint order by t) gap from swaps_v) select mint, round(t * 1000)::bigint ms, round(coalesce(least(greatest(1.5 * gap, 60), 1800), 300), 3) wanted from g")
def backfill_gaps(spark, d):
    """How much to fetch for the gap before each swap."""
    rows = tape.gaps(v.swaps(spark, d))
    return rows.select("mint", F.round(F.col("t") * 1000).cast("long").alias("ms"), F.round(streams.backfill_seconds("gap"), 3).alias("wanted"))


@query("sampled_events", "select event_id from events where (event_id * 2654435761) % 4294967296 < 429496730")
def sampled_events(spark, d):
    """A tenth of the events by a hash of their ids: the same rows every time."""
    return v.table(spark, d, "events").where((F.col("event_id") * 2654435761) % 4294967296 < 429496730).select("event_id")


ORDER_EVENTS = v.TRADES + """, c as (select o_orderkey order_id, o_totalprice / 3000 amount, o_orderdate ts from orders), f as (select order_id, ts, line, part, supp, quote, amount, price, fee from trades_v),
  s as (select c.order_id, any_value(c.amount) amount, coalesce(sum(f.amount), 0) filled, arg_max(f.price, (f.ts, line, part, supp, quote)) last_price, coalesce(sum(fee), 0) fee, count(f.price) fills, max(f.ts) last_ts from c left join f on f.order_id = c.order_id and f.ts >= c.ts group by c.order_id)"""


@query("order_events", f"""with {ORDER_EVENTS} select order_id, fills, round(filled, 2) filled, round(last_price, 6) last_price, round(fee, 8) fee, case when order_id % 13 = 0 and (last_ts is null or last_ts < timestamp '1995-01-01') then 'FAILED' when order_id % 11 = 0 and (last_ts is null or last_ts < timestamp '1996-01-01') then 'CANCELLED' when filled >= amount then 'FILLED' when fills > 0 then 'PARTIALLY_FILLED' else 'OPEN' end status from s""")
def order_events(spark, d):
    """Orders from their events: created, filled, cancelled and failed, each with its time; fills before the creation don't count."""
    o = v.table(spark, d, "orders")
    at = lambda *c: F.struct(*[F.col(x) if isinstance(x, str) else F.lit(x) for x in c])
    none = F.lit(None).cast("double")
    made = o.select(F.col("o_orderkey").alias("order_id"), F.lit("created").alias("kind"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 3000).alias("amount"), none.alias("price"), none.alias("fee"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("supp"), F.lit(0.0).alias("quote"))
    fills = v.trades(spark, d).select("order_id", F.lit("filled").alias("kind"), "ts", "amount", "price", "fee", "line", "part", "supp", "quote")
    ends = []
    for kind, k, day in (("cancelled", 11, "1996-01-01"), ("failed", 13, "1995-01-01")):
        ends.append(o.where(F.col("o_orderkey") % k == 0).select(F.col("o_orderkey").alias("order_id"), F.lit(kind).alias("kind"), F.lit(day).cast("timestamp_ntz").alias("ts"), none.alias("amount"), none.alias("price"), none.alias("fee"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("supp"), F.lit(0.0).alias("quote")))
    events = made.unionByName(fills).unionByName(ends[0]).unionByName(ends[1])
    states = orders.folded(events, at("ts", "line", "part", "supp", "quote"))
    return rounded(rounded(rounded(states.select("order_id", "fills", "filled", "last_price", "fee", "status"), 2, "filled"), 6, "last_price"), 8, "fee")
