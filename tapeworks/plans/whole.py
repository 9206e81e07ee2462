"""Order books, executors, levels and pages over whole tables: every line, every executor, every mint."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book, history
from ..sources import views as v
from .market import rounded
from .registry import query

BEST = v.FULL_BOOK + ", r as (select *, case side when 'ask' then price else -price end best from book_v)"
VOLUME, QUOTE, PRICE = 20_000.0, 30_000_000.0, 3200.0


@query("books_depth", f"with {BEST} select pair, side, price, amount, row_number() over (partition by pair, side order by best) as level from r qualify level <= 5")
def books_depth(spark, d):
    """The five best levels of both sides of every book."""
    return book.depth(v.full_book(spark, d), 5).withColumn("level", F.col("level").cast("long"))


def _walk_sql(size: str, base: str, volume: float) -> str:
    return f"""with {BEST},
  c as (select *, {size} size, sum({size}) over (partition by pair, side order by best rows unbounded preceding) cum from r),
  k as (select *, greatest(least(size, {volume} - (cum - size)), 0) take from c)
  select pair, side, arg_min(price, cum) filter (cum >= {volume}) price, round(sum({base} * price) / nullif(sum({base}), 0), 4) vwap, round(sum(take), 2) taken, max(cum) >= {volume} enough
  from k group by pair, side"""


@query("books_walk_volume", _walk_sql("amount", "take", VOLUME))
def books_walk_volume(spark, d):
    """Price reached and average price for a volume, and whether the side holds it."""
    return rounded(rounded(book.walk(v.full_book(spark, d), VOLUME), 4, "vwap"), 2, "taken")


@query("books_walk_quote", _walk_sql("price * amount", "take / price", QUOTE))
def books_walk_quote(spark, d):
    return rounded(rounded(book.walk(v.full_book(spark, d), QUOTE, quote=True), 4, "vwap"), 2, "taken")


_AT = f"(side = 'ask' and price <= {PRICE}) or (side = 'bid' and price >= {PRICE})"


@query(
    "books_volume_for_price",
    f"with {v.FULL_BOOK} select pair, side, sum(case when {_AT} then amount else 0 end) volume, sum(case when {_AT} then amount * price else 0 end) quote_volume from book_v group by pair, side",
)
def books_volume_for_price(spark, d):
    return book.volume_for_price(v.full_book(spark, d), F.lit(PRICE))


@query(
    "books_summary",
    f"""with {v.FULL_BOOK}, s as (
    select pair, max(price) filter (side = 'bid') best_bid, min(price) filter (side = 'ask') best_ask, count(*) filter (side = 'bid') bids, count(*) filter (side = 'ask') asks from book_v group by pair)
  select pair, best_bid, best_ask, bids, asks, best_ask - best_bid spread, best_bid >= best_ask crossed from s""",
)
def books_summary(spark, d):
    """Best prices, levels of both sides and the spread of every book."""
    return book.summary(v.full_book(spark, d))


@query(
    "all_executors_union",
    f"""with {v.EXECUTORS}, live as (select executor_id, 'live' as origin, net_pnl from executors_v where status = 'RUNNING'), stored as (select executor_id, 'stored' as origin, net_pnl from executors_v)
  select * from live union all select * from stored where executor_id not in (select executor_id from live)""",
)
def all_executors_union(spark, d):
    """All executors once: the live ones as the engine has them, the rest as stored; the store also holds the live ones."""
    e = v.executors(spark, d)
    live = e.where("status = 'RUNNING'").select("executor_id", F.lit("live").alias("origin"), "net_pnl")
    stored = e.select("executor_id", F.lit("stored").alias("origin"), "net_pnl")
    return live.unionByName(stored.join(live, "executor_id", "left_anti"))


@query(
    "whole_level_analysis",
    f"""with {v.TRADES} select pair, connector as level, count(*) filter (side = 'BUY') trading, count(*) filter (side = 'SELL') waiting, strftime(max(ts) filter (line > 1), '%Y-%m-%d') last_update,
    round(min(price), 8) min_price, round(max(price), 8) max_price from trades_v group by pair, connector""",
)
def whole_level_analysis(spark, d):
    return v.trades(spark, d).groupBy("pair", F.col("connector").alias("level")).agg(
        F.count_if(F.col("side") == "BUY").alias("trading"), F.count_if(F.col("side") == "SELL").alias("waiting"), F.date_format(F.max(F.when(F.col("line") > 1, F.col("ts"))), "yyyy-MM-dd").alias("last_update"),
        F.round(F.min("price"), 8).alias("min_price"), F.round(F.max("price"), 8).alias("max_price"),
    )


@query(
    "sampled_pages",
    f"""with {v.SWAPS}, s as (select mint, floor(t / 21600)::bigint slot, max(t) t from swaps_v group by all)
  select mint, slot, t from s qualify row_number() over (partition by mint order by t desc) <= 20""",
)
def sampled_pages(spark, d):
    """The newest page of every mint, a state for each six hours: tasks keep a page's rows each before they are shuffled."""
    rows = v.swaps(spark, d).groupBy("mint", F.floor(F.col("t") / 21600).alias("slot")).agg(F.max("t").alias("t"))
    return history.newest_of(rows, ["mint"], ["t"], 20)
