"""Pages, newest rows, lookups and small reshapings that searches share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filters


def newest_of(df: DataFrame, keys: list[str], by: list[str], n: int) -> DataFrame:
    """The n rows of each key that are last by the columns `by` (Spark keeps n rows a key before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def keep_last(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row of each key: the last by the columns `by`, by a combining aggregate."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*by)).alias("_row")).select("_row.*")


def search_range(df: DataFrame, equal: Mapping[str, object], column: str, low, high) -> DataFrame:
    """Rows with the given values and low <= column <= high; both reach the scan."""
    return filters.search(df, equal, between=(column, low, high))


def flat_pools(pages: DataFrame) -> DataFrame:
    """(pool, token, price) of the tokens in JSON pages of pools; a price that is no number is null, as are broken pages' rows (none)."""
    schema = "pools array<struct<pool: string, tokens: array<struct<token: bigint, price: string>>>>"
    pools = pages.select(F.explode(F.from_json("page", schema)["pools"]).alias("p"))
    tokens = pools.select("p.pool", F.explode("p.tokens").alias("t"))
    return tokens.select("pool", "t.token", F.expr("try_cast(t.price as double)").alias("price"))


def cursor_page(df: DataFrame, ts: str, tie: str, cursor: str | None, limit: int) -> DataFrame:
    """The newest rows older than the cursor, and whether there are more; a cursor that is no time is ignored.

    One row more than the page is fetched; the page's own few rows are numbered in one task.
    """
    before = F.try_to_timestamp(F.lit(cursor))
    rows = df.where(before.isNull() | (F.col(ts) < before)) if cursor else df
    page = rows.orderBy(F.desc(ts), F.desc(tie)).limit(limit + 1)
    w = Window.orderBy(F.desc(ts), F.desc(tie))
    return page.withColumn("_r", F.row_number().over(w)).withColumn("has_more", F.max("_r").over(Window.partitionBy()) > limit).where(F.col("_r") <= limit).drop("_r")


def after_id(df: DataFrame, by: list[str], name: str, cursor) -> DataFrame:
    """The rows that follow the one with the cursor's id in descending order of `by`; all rows if there is none such."""
    mark = df.where(F.col(name) == cursor).agg(F.max(F.struct(*by)).alias("_mark"))  # one row
    return df.join(F.broadcast(mark)).where(F.col("_mark").isNull() | (F.struct(*by) < F.col("_mark"))).drop("_mark")


def with_children(parents: DataFrame, children: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each parent with the sorted array of its children's columns, empty if there are none."""
    own = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("children"))
    empty = F.array().cast(own.schema["children"].dataType)
    return parents.join(own, key, "left").withColumn("children", F.coalesce("children", empty))


def by_period(states: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """The oldest state of each period and key (an older one replaces the newer that was read before it)."""
    other = [c for c in states.columns if c not in (*keys, "ts")]
    rows = states.groupBy(F.date_trunc(unit, "ts").alias("period"), *keys).agg(F.min_by(F.struct("ts", *other), "ts").alias("s"))
    return rows.select("period", *keys, "s.*")


def priced(balances: DataFrame, oracle: DataFrame, exchange: DataFrame) -> DataFrame:
    """Balances with the price and value of their tokens: 1 for dollars, else the oracle's positive rate, else the exchange's price, else 0."""
    rows = balances.join(oracle.select("token", F.col("rate").alias("_o")), "token", "left").join(exchange.select("token", F.col("rate").alias("_e")), "token", "left")
    price = F.when(F.col("token").contains("USD"), 1.0).when(F.col("_o") > 0, F.col("_o")).otherwise(F.coalesce("_e", F.lit(0.0)))
    source = F.when(F.col("token").contains("USD"), "dollar").when(F.col("_o") > 0, "oracle").when(F.col("_e").isNotNull(), "exchange").otherwise("none")
    return rows.withColumns({"price": price, "source": source}).withColumn("value", F.col("price") * F.col("units")).drop("_o", "_e")


def merged(parts: DataFrame, keys: list[str], sums: list[str], lists: list[str]) -> DataFrame:
    """Accumulators of a key added up, and the different members of their lists in order."""
    return parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    )


def due(observed: DataFrame, schedule: DataFrame, done: DataFrame, now: Column | float) -> DataFrame:
    """(key, snapshot) of the scheduled snapshots whose offset has passed since `since` and that are not done; the schedule is a few rows."""
    rows = observed.join(F.broadcast(schedule), F.lit(now) - F.col("since") >= F.col("offset"))
    return rows.select("key", "snapshot").join(done, ["key", "snapshot"], "left_anti")
