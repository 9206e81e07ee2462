"""Boundaries, nulls and empty tables of the analytics operators, sinks and sources on small hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions import scalars
from tapeworks.operators import bars, controllers, filters, history, indicators, orders, panels, patterns, performance, scoring, tape
from tapeworks.sinks import tables
from tapeworks.sources import archive

TAPE = "mint long, trader long, is_buy int, volume double, price double, t double"


def swaps(spark, rows):
    """(t, price, volume, is_buy, trader) of one mint."""
    return spark.createDataFrame([(1, r[4] if len(r) > 4 else i, r[3] if len(r) > 3 else 1, float(r[2]) if len(r) > 2 else 1.0, float(r[1]), float(r[0])) for i, r in enumerate(rows)], TAPE)


def empty(spark, schema):
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def start(spark, g=0.0):
    return spark.createDataFrame([(1, g)], "mint long, g double")


def test_panel_window_is_closed(spark):
    """Swaps exactly at the start and 300 after it count, those a millisecond outside and dust don't."""
    rows = [(0, 1.0), (60, 1.1), (60.001, 1.2), (300, 1.3), (300.001, 9.0), (-0.001, 9.0), (150, 9.0, 0.01)] + [(200 + i, 1.0 + i / 100) for i in range(8)]
    got = panels.panel22(swaps(spark, rows), start(spark)).collect()[0]
    assert (got.swap_count_60, got.swap_count_300) == (2.0, 12.0) and got.drawdown == pytest.approx(0.0) and got.top1_swap_share == pytest.approx(1 / 12)
    assert panels.panel22(swaps(spark, rows[:9]), start(spark)).count() == 0
    assert panels.panel22(empty(spark, TAPE), start(spark)).count() == 0


def test_vpin_buckets_leave_out_the_last_instant(spark):
    """A trade exactly at 300 is in the window but in no bucket."""
    rows = [(i, 1.0, 1.0, i % 2) for i in range(10)] + [(300, 1.0, 50.0, 1), (300, 1.0, 50.0, 1), (300, 1.0, 50.0, 1)]
    got = panels.panel22(swaps(spark, rows), start(spark)).collect()[0]
    assert got.vpin == pytest.approx(0.0) and got.swap_count_300 == 13


def test_panel5_needs_a_reference(spark):
    few = swaps(spark, [(i, 1.0 + i / 10) for i in range(4)])
    tiny = swaps(spark, [(i, 1e-12) for i in range(9)])
    assert panels.panel5(few, start(spark)).count() == panels.panel5(tiny, start(spark)).count() == 0
    got = panels.panel5(swaps(spark, [(i, p) for i, p in enumerate([1, 1, 1, 1, 1, 1000, 1])]), start(spark)).collect()[0]
    assert got.peak_pnl == 100.0 and got.recoveries == 1


def test_ticks_of_few_swaps_are_zero(spark):
    assert panels.ticks(swaps(spark, [(0, 1), (1, 1)]), 180).collect()[0][1:] == (0.0,) * 5
    got = panels.ticks(swaps(spark, [(0, 1, 5), (0, 1, 5), (10, 1, 5)]), 180).collect()[0]
    assert got.gap_p10 == got.gap_p90 == 10.0 and got.size_skew == 0.0


BARS = [(0.0, 1.0, 5.0), (5.0, 1.1, 5.0), (59.0, 1.2, 5.0), (61.0, 1.3, 0.001), (125.0, 1.4, 5.0), (126.0, 9.9, 0.001), (127.0, 50.0, 4.0), (128.0, 1.5, 4.0)]


def test_bars_drop_dust_and_outliers(spark):
    s = spark.createDataFrame([(1, 0)], "mint long, start long")
    got = bars.clean_bars(swaps(spark, BARS), s, 60, 4, 0.01, 1.609, 10).orderBy("bar").collect()
    assert [(r.trades, r.bar_start, r.shifted) for r in got] == [(3, 0, False), (1, 60, False), (2, 120, False), (0, 180, False)]
    assert got[0].close == pytest.approx(1.2) and got[1].close == 1.3 and got[2].high == 1.5 and got[3].open == got[3].close == got[2].close and got[3].volume == 0


def test_leading_gap_voids_and_missing_window_shifts(spark):
    s = spark.createDataFrame([(1, -60)], "mint long, start long")
    assert bars.clean_bars(swaps(spark, BARS), s, 60, 4, 0.01, 1.609, 10).count() == 0
    assert bars.clean_bars(swaps(spark, BARS), s, 60, 4, 0.01, 1.609, 10, strict=False).count() == 3
    far = spark.createDataFrame([(1, 6000)], "mint long, start long")
    got = bars.clean_bars(swaps(spark, [(t + 30, p, v) for t, p, v in BARS]), far, 60, 4, 0.01, 1.609, 10)
    assert {(r.shifted, r.bar_start) for r in got.where("bar = 0").collect()} == {(True, 0)}


def test_two_rows_are_no_outliers(spark):
    two = swaps(spark, [(0, 1.0), (1, 100.0)])
    assert bars.without_outliers(two, ["mint"], 1.609).count() == 2
    none = swaps(spark, [(0, -1.0), (1, 0.0), (2, -3.0)])
    assert bars.without_outliers(none, ["mint"], 1.609).count() == 3


def test_median_price_status(spark):
    rows = swaps(spark, [(100, 1.0, 1), (99, 2.0, 1), (98, 3.0, 5), (10, 50.0, 100), (100, 4.0, 0.001)])
    price = lambda least, window: bars.median_price(rows, F.lit(100.0), window, 0.01, least).collect()[0]
    assert (price(3, 5.0).price, price(3, 5.0).status) == (3.0, "ok") and price(4, 5.0).status == "insufficient_swaps" and price(4, 5.0).price is None
    assert bars.median_price(rows, F.lit(1000.0), 5.0, 0.01, 1).collect()[0].status == "no_data"
    assert price(3, 2.0).qualified == 3  # a swap exactly as old as the window counts


def shape(spark, closes, entry=600, step=60):
    """Bars whose open is the close before and whose entry opens at the last close."""
    rows, was = [], 1.0
    for i, c in enumerate(closes):
        rows.append((1, float(i * step), was, max(was, c), min(was, c), c, 10.0 + i))
        was = c
    return spark.createDataFrame(rows, "mint long, offset double, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("closes, want", [
    ([1.0, 1.3, 1.3, 1.0, 0.95, 1.1, 1.15], "vshape"), ([1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.25], "steady"), ([1.0, 1.15, 1.2, 1.2, 1.15, 1.05, 1.05], "near"), ([1.0, 0.9, 0.8, 0.7, 0.7, 0.7, 0.7], "none"),
])
def test_patterns(spark, closes, want):
    assert patterns.pattern(shape(spark, closes), 300).collect()[0].pattern == want


def test_entry_bar_counts_only_if_inclusive(spark):
    rows = shape(spark, [1.0, 1.1, 1.2, 5.0, 5.0])
    n = lambda inclusive: patterns.entries(rows, 180, inclusive).count()
    assert (n(True), n(False)) == (4, 3)
    assert patterns.entries(rows, 120, False).count() == 0 and patterns.entries(rows, 1000, True).count() == 0


@pytest.mark.parametrize("closes, bumps", [
    ([], 0), ([0.0], 0), ([0.0, 0.06, 0.12, 0.18], 2), ([9.0, 0.06, 0.12, 0.18, 0.17, 0.24], 3), ([0.0, 0.06, 0.02, 0.12, 0.18], 1), ([0.0, 0.04, 0.05, 0.06, 0.10, 0.11], 0), ([0.0, 0.06, 0.04, 0.12, 0.08, 0.18, 0.24], 2),
    ([0.0, -0.1, 0.01, 0.06, 0.12, 0.05, 0.06, 0.2, 0.26], 2),
])
def test_stair_steps(spark, closes, bumps):
    """Worked by hand: the first rise only sets the high, a fall of more than 0.03 starts anew, further rises of more than 0.05 count."""
    table = spark.createDataFrame([(closes,)], "c array<double>")
    assert table.select(patterns.stair_bumps(F.col("c"))).collect()[0][0] == bumps


def test_thresholds_have_three_values(spark):
    rows = [(1.0, "high"), (0.5, "high"), (0.5, "low"), (None, "low"), (float("nan"), "high"), (float("inf"), "high"), (1.0, "other")]
    got = spark.createDataFrame(rows, "v double, o string").select(patterns.passes(F.col("v"), F.col("o"), F.lit(1.0))).collect()
    assert [r[0] for r in got] == [True, False, True, None, None, None, None]


def test_event_scan_takes_the_earliest(spark):
    rows = [(1, 60, 0.1, 1.0, None), (1, 120, 0.9, 1.0, None), (1, 180, 0.9, 1.0, 1.0), (2, 60, 0.9, None, None)]
    features = spark.createDataFrame(rows, "mint long, delay long, a double, b double, c double")
    table = spark.createDataFrame([("a", "x", "high", 0.5), ("b", "y", "high", 0.5), ("c", "y", "high", 0.5)], "feature string, family string, orientation string, threshold double")
    scan = lambda need: sorted(map(tuple, patterns.event_scan(features, table, need, ["x", "y"]).collect()))
    assert scan({"x": 1, "y": 1}) == [(1, 120)] and scan({"x": 1, "y": 2}) == [(1, 180)]


def test_injected_models(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "k long, a double")
    got = {r.k: r for r in scoring.scored(df, ["a"], scoring.Linear({"a": 2.0}, 0.0)).collect()}
    assert got[1].score == 2.0 and got[2].score is None and got[1].model_error is None
    bad = scoring.scored(df, ["a"], scoring.Linear({"b": 1.0}, 0.0)).withColumn("d", scoring.decision(F.col("score"), 0.5, F.lit(True), F.col("model_error").isNotNull())).collect()
    assert {(r.d, r.model_error) for r in bad} == {("SKIP_MODEL_ERROR", "predict_failed:KeyError")}
    assert {r.score for r in scoring.scored(df, ["a"], scoring.Linear({"a": 2.0}, 0.0), missing=3.0).collect()} == {2.0, 6.0}
    bands = spark.createDataFrame([(0.2,), (0.5,), (0.9,), (None,)], "s double").select(scoring.band(F.col("s"), {"hi": 0.8, "lo": 0.5}))
    assert [r[0] for r in bands.collect()] == ["none", "lo", "hi", None]


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (2, 1, None), (None, 7, "n")], "k long, at long, x string")
    for _ in range(2):
        tables.insert_once(rows, path, ["k"], [F.col("at")])
    got = sorted(map(tuple, spark.read.parquet(path).collect()), key=repr)
    assert got == sorted([(1, 3, "b"), (2, 1, None), (None, 7, "n"), (None, 7, "n")], key=repr)
    events = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, None, 2.0), (1, 3, None, None), (2, 1, None, None)], "k long, at long, x string, y double")
    assert sorted(map(tuple, tables.patched(events, ["k"], "at").select("k", "x", "y", "at").collect())) == [(1, "a", 2.0, 3), (2, None, None, 1)]
    assert tables.existing(spark, f"file://{tmp_path}/none", rows).count() == 0


def test_topics(spark):
    rows = spark.createDataFrame([("ns/b1/log",), ("ns/b1/log/x",), ("ns/b2/status",), ("other",)], "topic string")
    hit = lambda p: [r[0] for r in rows.where(tables.matches(F.col("topic"), p)).collect()]
    assert hit("ns/+/log") == ["ns/b1/log"] and hit("ns/b1/#") == ["ns/b1/log", "ns/b1/log/x"] and hit("n.") == []


def test_archives(spark, tmp_path):
    for name, amount in (("one", 2_500_000), ("two", 1)):
        spark.createDataFrame([("conf", "binance", "A-B", amount, 1_000_000, 3)], "config string, market string, symbol string, amount long, price long, trade_fee_in_quote long").write.parquet(f"file://{tmp_path}/archived/{name}/data/trade_fills.parquet")
    got = {r.instance: r for r in archive.discover(spark, f"file://{tmp_path}/archived", "trade_fills").collect()}
    assert sorted(got) == ["one", "two"]
    rows = got["one"]
    assert (rows.amount, rows.price, rows.trade_fee_in_quote, rows.connector_name, rows.trading_pair) == (2.5, 1.0, 3e-6, "binance", "A-B")
    path = spark.range(1).select(archive.instance(F.lit("file:/x/archived/bot_7/data/orders.parquet"))).collect()[0][0]
    assert path == "bot_7"
    seconds = spark.createDataFrame([(1.7e9,), (1.7e12,), (1.7e15,), (1.7e18,), (5.0,), (None,)], "t double").select(scalars.to_seconds(F.col("t"))).collect()
    assert [r[0] for r in seconds] == [1.7e9] * 4 + [None, None]
    health = {r.source: r.status for r in archive.health({"a": spark.range(1), "b": spark.range(0)}).collect()}
    assert health["a"] == "Correct" and health["b"] != "Correct" and health[None] != "Correct"


def test_jdbc_reads_in_partitions(spark, tmp_path):
    """The embedded database that comes with Spark."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).select(F.col("id").alias("K"), (F.col("id") * 2).alias("X")).write.jdbc(url, "T", properties={"driver": driver})
    got = archive.jdbc(spark, url, "T", driver, ("K", 0, 100, 4))
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("X")).collect()[0][0] == 9900
    assert archive.jdbc(spark, url, "(select K from T where K < 5) q", driver).count() == 5


def test_pages(spark):
    rows = spark.createDataFrame([(i, f"2024-01-{i:02d}") for i in range(1, 11)], "id long, day string").withColumn("ts", F.to_timestamp("day"))
    page = lambda cursor, n=4: history.cursor_page(rows, "ts", "id", cursor, n).collect()
    assert [r.id for r in page("2024-01-05")] == [4, 3, 2, 1] and not page("2024-01-05")[0].has_more and page("2024-01-06")[0].has_more
    assert [r.id for r in page("no time")] == [r.id for r in page(None)] == [10, 9, 8, 7]
    assert sorted(r.id for r in history.after_id(rows, ["ts"], "id", 3).collect()) == [1, 2] and history.after_id(rows, ["ts"], "id", 77).count() == 10
    with pytest.raises(ValueError):
        filters.newest(rows, ["id"], 1001)


def test_order_events(spark):
    schema = "order_id long, kind string, ts long, amount double, price double, fee double"
    rows = [(1, "created", 1, 10.0, None, None), (1, "filled", 0, 5.0, 9.0, 1.0), (1, "filled", 2, 4.0, 2.0, 0.1), (1, "filled", 3, 6.0, 3.0, 0.1), (2, "created", 1, 5.0, None, None), (2, "cancelled", 2, None, None, None), (3, "filled", 1, 1.0, 1.0, 0.0), (4, "created", 1, 5.0, None, None), (4, "cancelled", 2, None, None, None), (4, "filled", 3, 1.0, 7.0, 0.0)]
    got = {r.order_id: r for r in orders.folded(spark.createDataFrame(rows, schema), F.col("ts")).collect()}
    assert sorted(got) == [1, 2, 4] and (got[1].status, got[1].filled, got[1].last_price, got[1].fills) == ("FILLED", 10.0, 3.0, 2)
    assert got[2].status == "CANCELLED" and got[4].status == "PARTIALLY_FILLED"


def test_summary_is_the_last_running_row(spark):
    """Sells before any buy, a flat position, and a single fill."""
    rows = [("a", "SELL", 5.0, 10.0, 0.1, 1), ("a", "BUY", 5.0, 8.0, 0.1, 2), ("b", "BUY", 1.0, 3.0, 0.2, 1), ("c", "SELL", 2.0, 4.0, -0.5, 1), ("c", "SELL", 2.0, 5.0, 0.5, 2)]
    trades = spark.createDataFrame(rows, "pair string, side string, amount double, price double, fee double, ts long")
    run = performance.running(trades, ["pair"], ["ts"], F.col("ts"))
    last = history.keep_last(run, ["pair"], ["ts"])
    names = ["pair", "buy_volume", "sell_volume", "realized", "unrealized", "net_pnl", "net_pnl_all_fees", "cum_volume"]
    got = sorted(map(tuple, performance.summary(trades, ["pair"], ["ts"]).select(*names).collect()))
    assert got == [pytest.approx(x) if False else x for x in sorted(map(tuple, last.select(*names).collect()))]
    assert dict((r.pair, r.realized) for r in last.collect()) == {"a": 10.0, "b": 0.0, "c": 0.0}


def test_controllers(spark):
    one = spark.range(1)
    got = one.select(*[c.alias(n) for n, c in controllers.imbalance(F.lit(0.0), F.lit(5.0), 1.0, 0.1).items()]).collect()[0]
    assert (got.imbalance, got["share"], got.blocked) == (-5.0, 0.0, None)
    held = one.select(*[c.alias(n) for n, c in controllers.inventory(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(100.0), 0.5).items()]).collect()[0]
    assert tuple(held) == (1.0, 0.0, 0.0)
    parts = one.select(controllers.parts_of(F.array(F.lit(1.0), F.lit(3.0)), F.lit(8.0)).alias("p"), controllers.parts_of(F.array(F.lit(None).cast("double"), F.lit(None).cast("double")), F.lit(8.0)).alias("q")).collect()[0]
    assert parts.p == [2.0, 6.0] and parts.q == [4.0, 4.0]
    flat = spark.createDataFrame([(1, i, 5.0) for i in range(4)], "k long, at long, value double")
    assert controllers.pair_spread(flat, flat, 4, 1.0).collect()[0].signal is None
    assert controllers.pair_spread(flat, flat, 9, 1.0).count() == 0


def test_curve_swaps(spark):
    rows = [(1, 5, False, 0, "curve", 2_000_000_000, 0.0), (1, 5, False, 9, "signer", 0, 4.0), (2, 5, False, 0, "curve", -1, 0.0), (2, 5, False, 9, "signer", 0, 4.0), (3, 0, False, 0, "curve", 1, 0.0), (3, 0, False, 9, "signer", 0, 1.0), (4, 5, True, 0, "curve", 1, 0.0), (4, 5, True, 9, "signer", 0, 1.0)]
    got = controllers.curve_swaps(spark.createDataFrame(rows, "tx long, t long, failed boolean, owner long, role string, lamports long, tokens double")).collect()
    assert [tuple(r) for r in got] == [(1, 5, 9, 1, 2.0, 4.0, 0.5)]


def test_empty_tapes(spark):
    none = empty(spark, TAPE)
    s = empty(spark, "mint long, g double")
    for out in (panels.panel5(none, s), panels.panel22(none, s), panels.ticks(none, 10.0), panels.flow_micro(none, s, 600, 120.0, 120), panels.hawkes(none, 10.0, 5.0, 5.0), bars.recent(none, 5.0), tape.weighted_median(none, F.col("volume")), indicators.ema(tape.bars(none, 60), 5)):
        assert out.count() == 0
