"""Streams in event time over several batches: lateness, order, timers, and state that ends."""

from __future__ import annotations

import random

from tapeworks.streaming import folds
from tapeworks.streaming.ordered import arrivals, held_state, ordered, run_in_batches

SWAP = "mint long, is_buy int, volume double, price double, t double, seq long, ms long"


def swap(mint, t, price=1.0, volume=2.0, buy=1, seq=None):
    return (mint, buy, volume, price, float(t), int(t * 10) if seq is None else seq, int(t * 1000))


def test_late_rows_of_bars(spark):
    """The lateness is ten seconds: a row eight seconds behind still counts, one behind a closed bar comes out as late."""
    parts = [
        [swap(1, 5, 3.0), swap(1, 1, 2.0), swap(2, 3)],
        [swap(1, 69, 4.0), swap(1, 58, 5.0, buy=0)],
        [swap(1, 55, 9.0, seq=7), swap(1, 61, 1.0), swap(1, 71), swap(2, 200)],
        [swap(1, 59, 8.0), swap(1, 58.5, 8.0), (None, None, None, None, None, None, 9_000_000)],
    ]
    made, state = run_in_batches([spark.createDataFrame(p, SWAP) for p in parts], lambda s: folds.bars(s, 60, 10, "10 seconds"))
    got = {(r.mint, r.bar_start, r.late): r for r in made.collect()}
    assert set(got) == {(1, 0, False), (1, 60, False), (2, 0, False), (2, 180, False), (1, 0, True)}
    bar = got[1, 0, False]
    assert (bar.open, bar.high, bar.low, bar.close, bar.trades, bar.buys, bar.sells, bar.volume, bar.buy_volume) == (2.0, 9.0, 2.0, 5.0, 4, 3, 1, 8.0, 6.0)
    assert bar.vwap_close == (9 + 5) / 2 and got[1, 0, True].trades == 2
    assert (got[1, 60, False].open, got[1, 60, False].close, got[1, 60, False].trades) == (1.0, 1.0, 3)
    assert held_state(spark, state, "sums").count() == 0


ROW = "k long, ms long, x double, seq long"


def slow_status(rows, idle, evict):
    """(key, status, at, rows) of each key's ordered rows."""
    out = []
    for k in {r[0] for r in rows}:
        last, n = None, 0
        for ms in sorted(r[1] for r in rows if r[0] == k) + [None]:
            gap = 10**15 if ms is None else None if last is None else ms - last
            if gap is not None and gap >= idle:
                out.append((k, "idle", last + idle, n))
            if gap is not None and gap >= evict:
                out.append((k, "evicted", last + evict, n))
                n = 0
            if ms is not None:
                n += 1
                if gap is None or gap >= idle:
                    out.append((k, "running", ms, n))
                last = ms
    return sorted(out)


def test_status_of_shuffled_batches(spark):
    pick = random.Random(3)
    rows = [(k, 1000 + pick.randrange(400_000), pick.random(), i) for i, k in enumerate([pick.randrange(5) for _ in range(120)])]
    table = spark.createDataFrame(rows, ROW)
    fold = folds.Liveness("k", "ms", "x", 10, 30)
    for batches in (1, 3):
        made, state = run_in_batches(arrivals(table, "ms", table.seq, 60_000, batches), lambda s: ordered(s, "k", "ms", "60 seconds", ["seq"], fold, "k long, " + fold.schema))
        got = sorted((r.k, r.status, r.at_ms, r.rows) for r in made.where("not late").collect())
        assert got == slow_status(rows, 10_000, 30_000) and made.where("late").count() == 0
        assert held_state(spark, state).count() == 0  # every key was evicted


def test_evicted_keys_leave_no_state(spark):
    """Key 1 is evicted while key 2 goes on; a late row comes out apart and changes nothing."""
    parts = [[(1, 1000, 1.0, 0), (2, 1000, 1.0, 1)], [(2, 20_000, 1.0, 2), (2, 60_000, 2.0, 3)], [(2, 61_000, 3.0, 4), (1, 2000, 9.0, 5)]]
    fold = folds.Liveness("k", "ms", "x", 10, 30)
    made, state = run_in_batches([spark.createDataFrame(p, ROW) for p in parts], lambda s: ordered(s, "k", "ms", "0 seconds", ["seq"], fold, "k long, " + fold.schema))
    rows = made.collect()
    assert [(r.k, r.status) for r in rows if r.late] == [(1, None)]
    assert sorted((r.status, r.at_ms) for r in rows if r.k == 1 and not r.late) == [("evicted", 31_000), ("idle", 11_000), ("running", 1000)]
    held = held_state(spark, state).collect()
    assert [r.key.key for r in held] == ["2"]


def test_changes_see_rows_in_order(spark):
    """A row that arrives after a newer one is compared with the one before it, not with the newer one; keys are forgotten."""
    parts = [[(1, 1000, 1.0, 0), (1, 5000, 3.0, 1)], [(1, 3000, 1.2, 2), (1, 4000, 2.9, 3)], [(1, 90_000, 3.0, 4), (None, 10**9, None, None)]]
    fold = folds.Emitted("k", "ms", "ms", "x", folds.changed(0.3), forget=30)
    made, state = run_in_batches([spark.createDataFrame(p, ROW) for p in parts], lambda s: ordered(s, "k", "ms", "10 seconds", ["seq"], fold, "k long, t long, x double"))
    assert sorted((r.t, r.x) for r in made.collect()) == [(1000, 1.0), (4000, 2.9), (90_000, 3.0)]
    assert held_state(spark, state).count() == 0


def test_orders_in_shuffled_batches(spark):
    """Created after filled, a cancelled order that is filled later, and a failure without an order."""
    schema = "order_id long, ms long, kind string, amount double, price double, fee double, rank long"
    rank = {k: i + 1 for i, k in enumerate(folds.Orders.RANK)}
    event = lambda o, ms, kind, amount=None: (o, ms, kind, amount, 5.0 if kind == "filled" else None, 0.1 if kind == "filled" else None, rank[kind])
    parts = [
        [event(1, 3000, "filled", 4.0), event(1, 2000, "cancelled"), event(2, 1000, "filled", 9.0)],
        [event(1, 1000, "created", 6.0), event(2, 2000, "created", 3.0), event(3, 2500, "failed")],
        [event(1, 4000, "filled", 2.0), event(2, 4000, "failed"), event(2, 3900, "cancelled"), (None, 10**12, None, None, None, None, None)],
    ]
    fold = folds.Orders("order_id", "ms", 3600)
    made, state = run_in_batches([spark.createDataFrame(p, schema) for p in parts], lambda s: ordered(s, "order_id", "ms", "30 seconds", ["rank"], fold, "order_id long, " + fold.schema))
    seen = {}
    for r in sorted(made.collect(), key=lambda r: r.version):
        seen.setdefault(r.order_id, []).append((r.status, r.fills, r.filled))
    assert seen == {1: [("OPEN", 0, 0.0), ("CANCELLED", 0, 0.0), ("PARTIALLY_FILLED", 1, 4.0), ("FILLED", 2, 6.0)], 2: [("OPEN", 0, 0.0), ("CANCELLED", 0, 0.0), ("FAILED", 0, 0.0)]}
    assert held_state(spark, state).count() == 0


def test_groups_of_keys_and_slices_of_time(spark):
    """Many keys share a group and rows wait in slices that the watermark cuts; neither changes what comes out."""
    pick = random.Random(8)
    rows = [(k, 1000 + pick.randrange(400_000), pick.random(), i) for i, k in enumerate([pick.randrange(40) for _ in range(600)])]
    table = spark.createDataFrame(rows, ROW)
    fold = folds.Liveness("k", "ms", "x", 10, 30)
    for groups, width in ((1, 7000), (3, 10**9)):
        made, state = run_in_batches(arrivals(table, "ms", table.seq, 60_000, 3), lambda s: ordered(s, "k", "ms", "60 seconds", ["seq"], fold, "k long, " + fold.schema, groups, width))
        assert sorted((r.k, r.status, r.at_ms, r.rows) for r in made.where("not late").collect()) == slow_status(rows, 10_000, 30_000) and made.where("late").count() == 0
        assert held_state(spark, state).count() == 0 and held_state(spark, state, "index").count() == 0


def test_a_release_reads_one_slice_at_a_time():
    """A worker never holds the rows of a hot key's other slices, and a group of many keys takes few calls of the state."""
    import json

    import pandas as pd

    from tapeworks.streaming import ordered as streams

    class Value:
        def __init__(self, log):
            self.value, self.log = None, log

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.log.append("put")
            self.value = value

        def clear(self):
            self.value = None

    class Map(dict):
        most = 0

        def updateValue(self, key, value):
            self[key] = value

        def getValue(self, key):
            self.most = max(self.most, len(json.loads(self[key][0])))
            return self[key]

        def removeKey(self, key):
            del self[key]

    class Handle:
        def __init__(self):
            self.log, self.map, self.timers = [], Map(), []

        def getMapState(self, *_):
            return self.map

        def getValueState(self, *_):
            return Value(self.log)

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Times:
        def __init__(self, mark):
            self.getCurrentWatermarkInMs = lambda: mark

    handle, made = Handle(), streams._Ordered(folds.Liveness("k", "ms", "x", 10, 30), "k", "ms", ["seq"], ["k", "status", "at_ms", "last_ms", "last_value", "rows"], 1000)
    made.init(handle)
    rows = [{"k": i % 50, "ms": 10 * i, "x": 1.0, "seq": i} for i in range(1000)]
    random.Random(1).shuffle(rows)
    frame = pd.DataFrame({"ms": [r["ms"] for r in rows], "row": [json.dumps(r) for r in rows]})
    assert not list(made.handleInputRows(("7",), iter([frame]), Times(-1)))
    assert len(handle.map) == 10 and handle.timers == [0]
    out = pd.concat(list(made.handleExpiredTimer(("7",), Times(9_999), None)))
    assert len(out) == 50 and handle.map.most == 100 and not handle.map and len(handle.log) == 2
