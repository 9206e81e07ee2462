"""Exact quantiles of keys of any size: selection by rank between bounds that a bounded sketch gives.

percentile() holds the different values of a key in one aggregate. Here a first pass counts the rows and takes, for each quantile, two
approximate ones that are sure to lie on both sides of it; a second pass counts the rows below the lower bound and keeps those
between the bounds, a few in `accuracy`, whose order gives the value of the wanted rank.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact(rows: DataFrame, keys: list[str], value: str, of: Mapping[str, float], accuracy: int = 1000) -> DataFrame:
    """(keys, a double column for each quantile of `of`): between two values their mean by distance, as percentile() has it.

    Nulls do not count; a key without values has null quantiles. Memory: a sketch of about `accuracy` values a key, and in the second pass
    windows over the distinct values between a quantile's bounds, at most 8 in `accuracy` of the key's rows.
    """
    # the sketch is off by n / accuracy ranks at most, and the wanted ranks lie beside p * n
    shares = [s for p in of.values() for s in (max(0.0, p - 3 / accuracy), min(1.0, p + 3 / accuracy))]
    known = rows.select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = known.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", shares, accuracy).alias("_b"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    few = F.col("_n") <= accuracy
    bound = lambda i, end: F.when(few, F.col(end)).otherwise(F.get("_b", F.lit(i)))
    places = F.array(*[F.struct(F.lit(i).alias("q"), (F.lit(p) * (F.col("_n") - 1)).alias("at"), bound(2 * i, "_min").alias("low"), bound(2 * i + 1, "_max").alias("high")) for i, p in enumerate(of.values())])
    sketch = sketch.withColumn("_q", places)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on = same[0] if same else F.lit(True)
    for s in same[1:]:
        on = on & s
    wide = known.where(F.col("_v").isNotNull()).join(sketch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_q"), on).select(*keys, "_v", F.explode("_q").alias("_q"))
    # values below the bounds are one row for each task and quantile, those between them one for each value
    inside = F.when(F.col("_v") >= F.col("_q.low"), F.col("_v"))
    counts = wide.where(F.col("_v") <= F.col("_q.high")).groupBy(*keys, "_q", inside.alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys, "_q.q").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_end", F.sum("_c").over(w))
    low, high = F.floor("_q.at"), F.ceil("_q.at")
    holds = lambda r: (F.col("_end") > r) & (F.col("_end") - F.col("_c") <= r)
    found = ranked.where(F.col("_v").isNotNull()).groupBy(*keys, F.col("_q.q").alias("_i")).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_z"), F.max(F.col("_q.at") - low).alias("_f")
    )
    x = F.col("_a") + F.col("_f") * (F.col("_z") - F.col("_a"))
    done = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, x)).alias(name) for i, name in enumerate(of)])
    return done
