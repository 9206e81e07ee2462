"""Running values and neighbourhoods of keys of any size, without a task that holds a whole key.

A key's rows are cut into slices along its order. scan() takes running values inside each slice, scans the slices' totals
(a row for each slice) and adds what came before: a hot key is as many window partitions as it has slices. blocks() copies
rows to the neighbouring blocks of time that their surroundings reach into, so that counts around a row are made inside
blocks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE: Mapping[str, Column] = {}


def slices(rows: DataFrame, keys: list[str], slice_: Column) -> DataFrame:
    """The rows with `_slice`, their keys' values and slice: one column that windows, totals and joins share, so that rows are dealt once. It is never null."""
    return rows.withColumn("_slice", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], slice_.alias("of")))


def along(keys: list[str]) -> Window:
    """The slices of each key in their order."""
    return Window.partitionBy(*[F.col("_slice")[f"k{i}"] for i in range(len(keys))]).orderBy(F.col("_slice"))


def scan(
    rows: DataFrame, keys: list[str], order: list[str], slice_: Column, sums: Mapping[str, Column] = NONE, peaks: Mapping[str, Column] = NONE, before: Mapping[str, Column] = NONE, keep: bool = False
) -> DataFrame:
    """The rows with running sums and maxima (themselves included) and the values of the row before, in `order` within their keys.

    slice_ must not fall along the order and be equal for rows that are equal in order[0]. No key (an empty list) means one scan over all rows. A
    sum counts nulls as 0; the value before a key's first row is null. Slices of one key should be few enough for one
    window partition and their rows few enough for a task; the results do not depend on them. `keep` leaves `_slice` (see slices), by which the rows are dealt.
    """
    at = F.struct(*order)
    cut = slices(rows, keys, slice_)
    totals = [F.sum(F.coalesce(c, F.lit(0))).alias(f"_s_{n}") for n, c in sums.items()] + [F.max(c).alias(f"_p_{n}") for n, c in peaks.items()]
    totals += [F.max_by(F.struct(c.alias("v")), at).alias(f"_b_{n}") for n, c in before.items()]
    ends = cut.groupBy("_slice").agg(*totals)
    earlier = along(keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(
        "_slice", *[F.sum(f"_s_{n}").over(earlier).alias(f"_s_{n}") for n in sums], *[F.max(f"_p_{n}").over(earlier).alias(f"_p_{n}") for n in peaks],
        *[F.lag(f"_b_{n}").over(along(keys))["v"].alias(f"_b_{n}") for n in before],
    )
    inside = Window.partitionBy("_slice").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = [F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(f"_ls_{n}") for n, c in sums.items()] + [F.max(c).over(so_far).alias(f"_lp_{n}") for n, c in peaks.items()]
    local += [F.lag(F.struct(c.alias("v"))).over(inside).alias(f"_lb_{n}") for n, c in before.items()]
    made = cut.select("*", *local).join(offsets, "_slice", "left")
    out = {n: F.col(f"_ls_{n}") + F.coalesce(F.col(f"_s_{n}"), F.lit(0)) for n in sums} | {n: F.greatest(f"_lp_{n}", f"_p_{n}") for n in peaks}
    out |= {n: F.when(F.col(f"_lb_{n}").isNull(), F.col(f"_b_{n}")).otherwise(F.col(f"_lb_{n}")["v"]) for n in before}
    return made.select(*rows.columns, *[c.alias(n) for n, c in out.items()], *["_slice"] * keep)


def _copies(rows: DataFrame, t: str, width: float, reach: dict[int, Column]) -> DataFrame:
    """Each row in its own block of time (side 0, at t) and, for the sides of `reach`, in the neighbouring block at another time.

    Columns added: _id, _block, _side, _at; `_row` holds the row in its own block only.
    """
    block = F.floor(F.col(t) / width)
    one = lambda side, at: F.struct((block + side).alias("block"), F.lit(side).alias("side"), at.cast("double").alias("at"))
    copies = F.array(one(0, F.col(t)), *[one(side, at) for side, at in reach.items()])
    row = F.struct(*rows.columns)
    made = rows.withColumn("_row", row).withColumn("_id", F.monotonically_increasing_id()).withColumn("_c", F.explode(copies))
    return made.select(*rows.columns, "_id", F.col("_c.block").alias("_block"), F.col("_c.side").alias("_side"), F.col("_c.at").alias("_at"), F.when(F.col("_c.side") == 0, F.col("_row")).alias("_row"))


def followers(rows: DataFrame, keys: list[str], t: str, seconds: float, name: str) -> DataFrame:
    """The number of rows of the same keys that come after a row, strictly, and within `seconds`. Rows without t have none and are not counted."""
    copies = _copies(rows, t, seconds, {1: F.col(t) + seconds})
    here = Window.partitionBy(*keys, "_block")
    own = F.when((F.col("_side") == 0) & F.col(t).isNotNull(), 1).otherwise(0)
    up_to = F.sum(own).over(here.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    part = F.when(F.col("_side") == 0, F.sum(own).over(here) - up_to).otherwise(up_to)
    made = copies.withColumn("_n", F.when(F.col(t).isNotNull(), part).otherwise(0)).groupBy("_id").agg(F.sum("_n").alias("_n"), F.max("_row").alias("_row"))
    return made.select("_row.*", F.col("_n").alias(name))


def _greatest(x: Column, window, k: int) -> list[tuple[str, Column]]:
    """Steps that give the k greatest values so far in a window: what a running maximum beats goes on to the next one."""
    before, steps = window.rowsBetween(Window.unboundedPreceding, -1), []
    for j in range(k):
        value = x if j == 0 else F.col(f"_x{j}")
        steps.append((f"_m{j}", F.max(value).over(window.rowsBetween(Window.unboundedPreceding, 0))))
        steps.append((f"_x{j + 1}", F.when(value.isNotNull() & F.max(value).over(before).isNotNull(), F.least(value, F.max(value).over(before)))))
    return steps[:-1]


def _same(pairs: list[tuple[str, str]]) -> Column:
    """Equality of columns of two tables in which a null equals a null."""
    same = F.lit(True)
    for a, b in pairs:
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def supported(rows: DataFrame, keys: list[str], t: str, price: str, seconds: float, share: float, least: int, name: str) -> DataFrame:
    """Whether at least `least` rows of the keys within `seconds` (itself included) have `share` (not negative) of a row's price or more.

    A block of `seconds` is within reach of each of its rows, so its `least` greatest prices settle all rows that these support. Only the
    open rest (of positive prices fewer than `least` rows a block) looks into the blocks beside: copies go there, and running maxima of the
    `least` greatest prices tell what they find. A row without t or price is not supported.
    """
    known = F.col(t).isNotNull() & F.col(price).isNotNull()
    cut = rows.where(known).withColumn("_block", F.floor(F.col(t) / seconds))
    cell, tops, all_ = [*keys, "_block"], [f"_m{j}" for j in range(least)], [f"_all{j}" for j in range(least)]
    enough = lambda c, of=price: F.when(F.col(c) >= share * F.col(of), 1).otherwise(0)
    best = cut.select(*cell, F.col(price).alias("_p")).withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("_p")))).where(F.col("_r") <= least)
    best = best.groupBy(*[F.col(c).alias(f"_k_{c}") for c in cell]).agg(*[F.max(F.when(F.col("_r") == j + 1, F.col("_p"))).alias(c) for j, c in enumerate(all_)])
    own, here = sum(enough(c) for c in all_), _same([(c, f"_k_{c}") for c in cell])
    closed = cut.join(best, here).where(own >= least).select(*rows.columns, F.lit(True).alias(name))
    # a block has open rows if its greatest price is one
    unsettled = best.where(sum(enough(c, all_[0]) for c in all_) < least)
    open_ = cut.join(unsettled, here).where(own < least).withColumn("_row", F.struct(*rows.columns)).withColumn("_id", F.monotonically_increasing_id()).withColumn("_own", own)
    one = lambda side: F.struct((F.col("_block") + side).alias("block"), F.lit(side).alias("side"), (F.col(t) + side * seconds).cast("double").alias("at"))
    copies = open_.withColumn("_c", F.explode(F.array(one(1), one(-1))))
    copies = copies.select(*keys, F.col("_c.block").alias("_block"), F.col("_c.side").alias("_side"), F.col("_c.at").alias("_at"), F.col(price).alias("_p"), "_id", "_own", "_row")
    beside = unsettled.select(*[f"_k_{k}" for k in keys], F.explode(F.array(F.col("_k__block") - 1, F.col("_k__block") + 1)).alias("_k__block")).distinct()
    near = cut.join(beside, here, "left_semi").select(*cell, F.lit(0).alias("_side"), F.col(t).cast("double").alias("_at"), F.col(price).alias("_p"))
    items = near.unionByName(copies, allowMissingColumns=True)
    inside, seen = Window.partitionBy(*cell), F.when(F.col("_side") == 0, F.col("_p"))
    for way, order in (("_up", inside.orderBy("_at", F.abs("_side"))), ("_down", inside.orderBy(F.desc("_at"), F.abs("_side")))):
        for step, column in _greatest(seen, order, least):
            items = items.withColumn(step, column)
        items = items.withColumn(way, sum(enough(m, "_p") for m in tops))
    found = F.when(F.col("_side") == 1, F.col("_up")).otherwise(F.col("_down"))
    made = items.where(F.col("_side") != 0).groupBy("_id").agg((F.sum(found) + F.first("_own") >= least).alias(name), F.first("_row").alias("_row")).select("_row.*", name)
    return closed.unionByName(made).unionByName(rows.where(~known).withColumn(name, F.lit(False)))
