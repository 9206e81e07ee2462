"""Segmented scans and neighbourhoods against whole-key windows, with a hot key and slices of any width."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.operators import performance, scans, tape

ROW = "k long, t long, n long, x double"


def table(spark, rows=400, keys=3, times=90, seed=1):
    pick = random.Random(seed)
    # key 0 has over a third of all rows, ties in t, nulls in x and in the key
    made = [(pick.choice([0, 0, 0, *range(keys), None]), pick.randrange(times), i, pick.choice([None, pick.uniform(-5, 5), pick.uniform(-5, 5)])) for i in range(rows)]
    return spark.createDataFrame(made, ROW).repartition(5)


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_scan(spark, width, keys):
    df, order = table(spark), ["t", "n"]
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum(F.coalesce("x", F.lit(0))).over(so_far).alias("total"), F.max("x").over(so_far).alias("top"), F.lag("x").over(w).alias("was"), F.row_number().over(w).cast("long").alias("i"))
    got = scans.scan(df, keys, order, F.floor(F.col("t") / width), {"total": F.col("x"), "i": F.lit(1).cast("long")}, {"top": F.col("x")}, {"was": F.col("x")})
    rows = lambda d: sorted(((r.n, round(r.total, 9), r.top, r.was, r.i) for r in d.collect()), key=repr)
    assert rows(got) == rows(want) and len(rows(got)) == 400


def test_a_hot_key_is_many_tasks(spark):
    """No window partition of a scan holds more rows than a slice, though one key has all."""
    df = spark.range(6000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("x"))
    got = scans.scan(df, ["k"], ["t"], F.floor(F.col("t") / 100), {"total": F.col("x")})
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_slice" in line for line in windows)
    spread = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert got.agg(F.max("total")).first()[0] == 6000.0 and (len(spread) > 1 or spread[0]["count"] == 6000)


def test_empty(spark):
    none = spark.createDataFrame([], ROW)
    assert scans.scan(none, ["k"], ["t"], F.col("t"), {"s": F.col("x")}).count() == 0
    assert scans.followers(none, ["k"], "t", 5, "n2").count() == 0
    assert scans.supported(none, ["k"], "t", "x", 5, 0.8, 3, "ok").count() == 0


@pytest.mark.parametrize("seconds", [1, 6, 40, 500])
def test_neighbourhoods(spark, seconds):
    df = table(spark, 300)
    rows = df.collect()
    near = {r.n: sum(1 for o in rows if o.k == r.k and 0 < o.t - r.t <= seconds) for r in rows}
    assert {r.n: r.later for r in scans.followers(df, ["k"], "t", seconds, "later").collect()} == near
    for least in (1, 2, 4):
        want = {r.n: r.x is not None and sum(1 for o in rows if o.k == r.k and abs(o.t - r.t) <= seconds and o.x is not None and o.x >= 0.8 * r.x) >= least for r in rows}
        assert {r.n: r.ok for r in scans.supported(df, ["k"], "t", "x", seconds, 0.8, least, "ok").collect()} == want


def test_no_array_per_row(spark):
    plan = tape.confirmed(spark.createDataFrame([(1, 1.0, 2.0)], "mint long, t double, price double"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan


def test_global_drawdown(spark):
    """The sum of two keys' newest results falls from 30 to -5 although neither falls by 30 alone."""
    rows = [("a", 1, 10.0), ("b", 2, 20.0), ("a", 3, -5.0), ("b", 4, 0.0), ("a", 5, -6.0)]
    df = spark.createDataFrame(rows, "k string, ts long, pnl double")
    got = performance.global_drawdown(df, ["k"], ["ts"], "pnl", 30.0, F.floor(F.col("ts") / 2)).first()
    assert (got.max_drawdown, got.tripped_at, got.tripped) == (36.0, 4, True)
    calm = performance.global_drawdown(df, ["k"], ["ts"], "pnl", 36.0, F.col("ts")).first()
    assert (calm.tripped_at, calm.tripped) == (None, False)


@pytest.mark.parametrize("length, alpha", [(3, 0.5), (12, 2 / 13), (5, 1.0), (40, 1 / 40)])
def test_recurrences_by_parts(spark, length, alpha):
    """Series of several parts, with nulls before and between, a negative one, and one that is too short."""
    import numpy as np

    from tapeworks.operators import recurrences

    pick = random.Random(4)
    series = {1: [None] * 7 + [pick.uniform(50, 150) for _ in range(3000)], 2: [pick.uniform(-1, 1) for _ in range(900)], 3: [1.0] * (length - 1), 4: [pick.choice([None, 5.0, 6.0]) for _ in range(400)]}
    df = spark.createDataFrame([(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)], "mint long, bar_start long, x double").repartition(6)
    got = {(r.mint, r.bar_start): r.e for r in recurrences.recurrence(df, "x", length, alpha, "e").collect()}
    for k, xs in series.items():
        known = [i for i, x in enumerate(xs) if x is not None]
        want = recurrences.smoothed(np.array([xs[i] for i in known], float), length, alpha)
        for i, w in zip(known, want):
            assert (got[k, i] is None) == bool(np.isnan(w)) and (np.isnan(w) or got[k, i] == pytest.approx(w, rel=1e-12, abs=1e-12))
        assert all(got[k, i] is None for i, x in enumerate(xs) if x is None)


def test_recurrences_stay_in_the_jvm(spark):
    from tapeworks.operators import indicators, recurrences

    bars = spark.createDataFrame([(1, 0, 2.0, 1.0, 1.5)], "mint long, bar_start long, high double, low double, close double")
    for made in (indicators.ema(bars, 3), recurrences.macd(bars, 3, 5, 2), recurrences.volatility_shift(bars, 3, 3, 5, 2)):
        assert not [p for p in ("Python", "Pandas", "Arrow") if p in made._jdf.queryExecution().executedPlan().toString()]


def test_ties_are_ordered_by_number(spark):
    """A tape with equal times gives one result however its rows are dealt."""
    pick = random.Random(9)
    rows = [(1, i % 7, pick.randrange(2), float(pick.randrange(1, 9)), 1.0 + pick.random(), float(i // 6), i) for i in range(240)]
    schema = "mint long, trader long, is_buy int, volume double, price double, t double, seq long"
    seen = set()
    for seed in range(3):
        pick.shuffle(rows)
        df = spark.createDataFrame(rows, schema).repartition(1 + 3 * seed)
        made = [tape.bars(df, 10).orderBy("bar_start"), tape.recent_median(df), tape.short_trend(df, -0.1, 0.1), tape.streaks(df), tape.impact(df), tape.log_returns(df).agg(F.round(F.sum("log_return"), 9), F.round(F.sum(F.col("log_return") * F.col("seq")), 6))]
        seen.add(repr([[tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in m.collect()] for m in made]))
    assert len(seen) == 1


def test_supported_copies_open_rows_only(spark):
    """A task keeps no copies of rows that their own block settles: the windows get the open ones and the blocks beside them."""
    rows = [(1, float(t), 1.0 + t % 7 / 10, t) for t in range(400)] + [(1, 409.0, 99.0, 1000), (1, 411.0, 90.0, 1001), (1, 419.0, 80.0, 1002), (1, 430.0, -2.0, 1003), (1, 431.0, -1.0, 1004), (1, 432.0, -1.5, 1005)]
    df = spark.createDataFrame(rows, "mint long, t double, price double, seq long")
    got = tape.confirmed(df, 10)
    near = {r[3]: sum(1 for o in rows if abs(o[1] - r[1]) <= 10 and o[2] >= 0.8 * r[2]) >= 3 for r in rows}
    assert {r.seq: r.confirmed for r in got.collect()} == near and near[1000] and not near[1003]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan  # of settled blocks no more than the greatest prices are sorted


def test_peak_since_is_not_bound_to_a_task_a_mint(spark):
    """The swaps meet their mint's time without an exchange by mint, after which a task would hold all of a mint's blocks."""
    from tapeworks.plans import registry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["peak_since"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.split("\n") if "Join [mint#" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_drawdowns_against_loops(spark, width):
    """Falls inside slices and across them, one below zero only, nulls in the key; the rows of running() are dealt once."""
    pick = random.Random(width)
    rows = [(pick.choice(["a", "a", "b", None]), pick.randrange(60), i, pick.uniform(-50, 40) - 20 * (i % 3)) for i in range(300)]
    rows += [("c", 5, 900, -7.0), ("c", 50, 901, -9.0)]
    df = spark.createDataFrame(rows, "k string, ts long, n long, pnl double").repartition(5)
    want, newest, top, worst, tripped, seen = {}, {}, 0.0, 0.0, None, {}
    for k, ts, _, x in sorted(rows, key=lambda r: r[1:3]):
        seen[k] = max(seen.get(k, 0.0), x)
        want[k] = max(want.get(k, 0.0), seen[k] - x)
        newest[k] = x
        top = max(top, sum(newest.values()))
        worst = max(worst, top - sum(newest.values()))
        if tripped is None and top - sum(newest.values()) > 90:
            tripped = ts
    part = F.floor(F.col("ts") / width)
    got = performance.drawdown(df, ["k"], ["ts", "n"], "pnl", 90.0, part)
    assert {r.k: (r.max_drawdown, r.tripped) for r in got.collect()} == {k: (pytest.approx(x), x > 90) for k, x in want.items()}
    one = performance.global_drawdown(df, ["k"], ["ts", "n"], "pnl", 90.0, part).first()
    assert (one.max_drawdown, one.tripped_at, one.tripped) == (pytest.approx(worst), tripped, tripped is not None)


def test_drawdown_deals_trades_once(spark):
    """Between the trades and their falls there is one exchange of rows; what else is exchanged are slices."""
    from tapeworks.plans import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.QUERIES["max_drawdown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.split("\n")
    windows = [i for i, line in enumerate(lines) if "Window [" in line and "_fall" not in line and "max(" not in line]
    trades = [line for line in lines if "Exchange hashpartitioning(_slice" in line]
    assert windows and 1 <= len(trades) <= 3 and not [line for line in lines if "Exchange hashpartitioning(coalesce" in line]
