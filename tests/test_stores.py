"""Versioned tables, swaps from balances, event states, and the fresh-price operators on small hand-made tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import balances, patterns, tape
from tapeworks.plans import events, registry
from tapeworks.sinks import layout, versioned

ROW = "k long, a long, b string, at long"


def rows_of(df):
    return sorted((tuple(r) for r in df.select("k", "a", "b").collect()), key=repr)


def make(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_patches_and_compaction(spark, tmp_path):
    path, like = f"file://{tmp_path}/t", make(spark, [])
    read = lambda version=None: rows_of(versioned.read(spark, path, like, ["k"], ["at"], version))
    assert read() == [] and versioned.versions(spark, path) == []
    assert versioned.patch(make(spark, [(1, 10, "x", 5), (2, 20, "y", 5), (2, 21, None, 6)]), path, "one") == 1
    assert read() == [(1, 10, "x"), (2, 21, "y")]
    # an older time in a newer run still goes before; null leaves what is there; a new key is inserted
    versioned.patch(make(spark, [(1, None, "z", 1), (3, 30, None, 1), (None, 1, "n", 1)]), path, "two")
    after = [(1, 10, "z"), (2, 21, "y"), (3, 30, None), (None, 1, "n")]
    assert read() == sorted(after, key=repr) and read(1) == [(1, 10, "x"), (2, 21, "y")]
    assert versioned.compact(spark, path, like, ["k"], ["at"], "c") == 3
    assert read() == sorted(after, key=repr) and versioned.manifest(spark, path)["runs"] == ["c"]
    # reruns of every job change nothing
    assert versioned.patch(make(spark, [(9, 9, "9", 9)]), path, "one") == 3
    assert versioned.compact(spark, path, like, ["k"], ["at"], "c") == 3 and read() == sorted(after, key=repr)


def test_killed_jobs_leave_the_table_whole(spark, tmp_path):
    path, like = f"file://{tmp_path}/t", make(spark, [])
    versioned.patch(make(spark, [(1, 10, "x", 5)]), path, "one")
    # killed between writing and publishing: nobody sees the data, and the rerun takes its place
    make(spark, [(7, 7, "half", 1)]).write.parquet(f"{path}/data/two")
    make(spark, [(8, 8, "half", 1)]).write.parquet(f"{path}/data/c")
    assert rows_of(versioned.read(spark, path, like, ["k"], ["at"])) == [(1, 10, "x")]
    versioned.patch(make(spark, [(2, 20, "y", 1)]), path, "two")
    versioned.compact(spark, path, like, ["k"], ["at"], "c")
    assert rows_of(versioned.read(spark, path, like, ["k"], ["at"])) == [(1, 10, "x"), (2, 20, "y")]


def test_jobs_at_once(spark, tmp_path, monkeypatch):
    """A patch that is published while a compaction writes is kept, and both of two writers of one version are there."""
    path, like = f"file://{tmp_path}/t", make(spark, [])
    versioned.patch(make(spark, [(1, 10, "x", 5)]), path, "one")
    publish, once = versioned._publish, []

    def late(*args):
        if not once:
            once.append(1)
            versioned.patch(make(spark, [(1, 11, None, 1), (2, 2, "b", 1)]), path, "between")
        return publish(*args)

    monkeypatch.setattr(versioned, "_publish", late)
    assert versioned.compact(spark, path, like, ["k"], ["at"], "c") == 3
    assert versioned.manifest(spark, path)["runs"] == ["c", "between"]
    assert rows_of(versioned.read(spark, path, like, ["k"], ["at"])) == [(1, 11, "x"), (2, 2, "b")]
    assert not publish(spark, path, 3, [], [])


def test_netted_swaps(spark):
    tx = [("buy", "B", "me", False, 1), ("sell", "B", "me", None, 2), ("failed", "B", "me", True, 3), ("early", "B", "me", False, None), ("moved", "B", "me", False, 5), ("coin", "B", "me", False, 6), ("gated", "B", "me", False, 7), ("other", "B", "me", False, 8), ("free", "B", "me", False, 9)]
    legs = [
        ("buy", 1, "B", "me", 0.0, 60.0), ("buy", 2, "B", "me", 10.0, 50.0), ("buy", 3, "B", "pool", 100.0, 0.0), ("buy", 4, "Q", "me", 9.0, 4.0), ("buy", 5, "Q", "pool", 0.0, 5.0), ("buy", 6, "X", "me", 1.0, 900.0),
        ("sell", 1, "B", "me", 8.0, None), ("sell", 2, "Q", "pool", 4.0, 2.0), ("failed", 1, "B", "me", 0.0, 1.0), ("failed", 2, "Q", "me", 1.0, 0.0), ("early", 1, "B", "me", 0.0, 1.0), ("early", 2, "Q", "me", 1.0, 0.0),
        # accounts of one owner that cancel out, so the pool's side tells
        ("moved", 1, "B", "me", 5.0, 0.0), ("moved", 2, "B", "me", 0.0, 5.0), ("moved", 3, "B", "pool", 9.0, 2.0), ("moved", 4, "Q", "pool", 0.0, 14.0),
        ("coin", 1, "B", "me", 0.0, 4.0), ("coin", 2, "Q", "fee", 0.0, 0.1), ("gated", 1, "B", "me", 0.0, 4.0), ("gated", 2, "Q", "me", 0.0, 3.0), ("other", 1, "Q", "me", 0.0, 3.0), ("free", 1, "B", "me", 0.0, 1.0),
    ]
    coins = [("coin", 1, 9 * 10**9, 1 * 10**9), ("coin", 2, 0, 7 * 10**9), ("coin", 3, 5, 100_005), ("free", 1, 0, 100_000)]
    got = balances.swaps(
        spark.createDataFrame(tx, "tx string, base string, signer string, failed boolean, t long"), spark.createDataFrame(legs, "tx string, account int, mint string, owner string, pre double, post double"),
        spark.createDataFrame(coins, "tx string, account int, pre long, post long"), "Q",
    )
    assert sorted((r.tx, r.is_buy, r.base_amount, r.quote_amount) for r in got.collect()) == [("buy", 1, 100.0, 5.0), ("coin", 1, 4.0, 8.0), ("moved", 1, 7.0, 14.0), ("sell", 0, 8.0, 2.0)]


def test_netted_swaps_deals_more_lines_to_more_tasks(spark, monkeypatch):
    """A task gets LINES lines or so however many there are, and the swaps stay the same."""
    sf = "/root/testdata/sf0.01"
    whole = sorted(tuple(r) for r in registry.QUERIES["netted_swaps"](spark, sf).collect())
    monkeypatch.setattr(events, "LINES", 3000, raising=False)
    dealt = registry.QUERIES["netted_swaps"](spark, sf).withColumn("task", F.spark_partition_id()).collect()
    sizes = Counter(r.task for r in dealt)
    assert len(sizes) >= 20 and max(sizes.values()) <= 2 * len(dealt) / len(sizes)
    assert sorted(tuple(r)[:-1] for r in dealt) == whole


def test_event_states(spark):
    """A family with absent features passes on those that are there, if they are enough; persistence is told apart."""
    limits = spark.createDataFrame([("x", "a", "high", 1.0), ("y", "a", "low", 1.0), ("z", "p", "high", 0.5)], "feature string, family string, orientation string, threshold double")
    rows = [(1, 1, 2.0, None, None), (1, 2, 2.0, 0.5, None), (1, 3, 2.0, 0.5, 0.9), (2, 1, 0.0, 0.5, 0.9), (2, 2, 1.0, 1.0, 0.9)]
    states = patterns.event_states(spark.createDataFrame(rows, "mint long, delay long, x double, y double, z double"), limits, {"a": 2, "p": 1})
    assert {(r.mint, r.delay): (r.a, r.p) for r in states.collect()} == {(1, 1): (False, False), (1, 2): (True, False), (1, 3): (True, True), (2, 1): (False, True), (2, 2): (True, True)}
    assert {r.mint: (r.delay, r.with_p) for r in patterns.first_event(states, ["a"], "p").collect()} == {1: (2, False), 2: (2, True)}


def test_fresh_prices(spark):
    tape_rows = spark.createDataFrame([(1, 0.0, 5.0), (1, 90.0, 1.0), (1, 95.0, 3.0), (1, 100.0, 2.0), (2, 10.0, 9.0)], "mint long, t double, price double")
    assert {r.mint: r.median_price for r in tape.fresh_median(tape_rows, F.lit(100.0), 15).collect()} == {1: 2.0}
    assert {r.mint: r.median_price for r in tape.fresh_median(tape_rows, F.lit(100.0), 15, 1).collect()} == {1: 2.0}
    assert {r.mint: (r.peak, r.swaps) for r in tape.peak_since(tape_rows, F.lit(91.0), 20, least=2).collect()} == {1: (2.0, 2)}
    got = {r.mint: r.trend for r in tape.newest_trend(tape_rows, 15, -0.1, 0.1, ends=1, least=3).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] is None


def test_scans_of_a_layout_skip_files(spark, tmp_path):
    """A range of one key reads few of the files, also of a hot key; results are those of a filter."""
    path = f"file://{tmp_path}/tape"
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 40).alias("mint"), (F.col("id") * 7919 % 20_000).cast("double").alias("t"), F.col("id").alias("seq"))
    rows = rows.union(spark.createDataFrame([(None, 1.0, -1), (7, None, -2)], rows.schema))
    layout.lay_out(rows, path, ["mint", "t"], 50)
    total = layout.files_of(spark, path).count()
    for mint, low, high, most in ((7, 1000.0, 1500.0, 4), (9, 0.0, 20_000.0, 4), (3, 5.0, 5.0, 4), (99, 0.0, 1.0, 0)):
        made = layout.scan(spark, path, {"mint": (mint, mint), "t": (low, high)})
        want = rows.where((F.col("mint") == mint) & F.col("t").between(low, high))
        assert sorted(r.seq for r in made.collect()) == sorted(r.seq for r in want.collect())
        assert len(want.head(1)) <= len(made.inputFiles()) <= most < total / 5
    made = layout.scan(spark, path, {"mint": (7, 7), "t": (1000.0, 1500.0)})
    made.collect()
    scans = [p for p in _plans(made._jdf.queryExecution().executedPlan()) if p.nodeName().startswith("Scan")]
    assert sum(p.metrics().get("numFiles").get().value() for p in scans) <= 4


def _plans(plan):
    """The nodes of an executed plan."""
    plan = plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan
    children = plan.children()
    return [plan, *[p for i in range(children.size()) for p in _plans(children.apply(i))]]


def test_a_layout_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    layout.lay_out(spark.createDataFrame([], "mint long, t double"), path, ["mint", "t"], 4)
    assert layout.scan(spark, path, {"mint": (1, 1)}).count() == 0
