"""Exact quantiles against percentile()."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import quantiles

OF = {"least": 0.0, "p10": 0.1, "middle": 0.5, "p90": 0.9, "most": 1.0}


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_exact(spark, accuracy):
    """Hot, tiny and empty keys, ties, nulls and a null key."""
    pick = random.Random(2)
    rows = [(1, pick.gauss(0, 1)) for _ in range(5000)] + [(2, float(pick.randrange(4))) for _ in range(1000)] + [(3, 5.0), (4, None), (4, None), (5, 1.0), (5, 2.0), (None, 7.0), (None, 9.0), (1, None)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(7)
    got = {r.k: tuple(r)[1:] for r in quantiles.exact(df, ["k"], "x", OF, accuracy).collect()}
    want = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(*[F.percentile("x", p).alias(n) for n, p in OF.items()]).collect() if r.least is not None}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_nothing(spark):
    assert quantiles.exact(spark.createDataFrame([], "k long, x double"), ["k"], "x", OF).count() == 0
