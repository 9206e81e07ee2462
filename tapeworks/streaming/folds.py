"""What streams keep for a key: bars, liveness with eviction, order states, change-only and rate-limited emission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .ordered import NO_KEY, Fold

BAR = "mint long, bar_start long, open double, high double, low double, close double, volume double, trades long, buys long, sells long, buy_volume double, vwap_close double, late boolean"


class _Bars(StatefulProcessor):
    """Sums of one bar, merged from each batch's rows, until the watermark is past its end."""

    def __init__(self, tail_ms: int, width_ms: int):
        self.tail, self.width = tail_ms, width_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "t0 double, s0 long, p0 double, t1 double, s1 long, p1 double, high double, low double, volume double, trades long, buys long, sells long, bought double, tail_quote double, tail_volume double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == NO_KEY:
            return
        mint, start = map(int, key[0].split(":"))
        end, late, new = start + self.width, 0, None
        closed = end <= timerValues.getCurrentWatermarkInMs()
        for f in rows:
            if closed:
                late += len(f)
                continue
            f = f.sort_values(["t", "seq"])
            a, z, buy, tail = f.iloc[0], f.iloc[-1], f["is_buy"] == 1, f["ms"] >= end - self.tail
            new = merged(new, (
                float(a["t"]), int(a["seq"]), float(a["price"]), float(z["t"]), int(z["seq"]), float(z["price"]), float(f["price"].max()), float(f["price"].min()), float(f["volume"].sum()), len(f), int(buy.sum()), int((f["is_buy"] == 0).sum()),
                float(f["volume"][buy].sum()), float((f["price"] * f["volume"])[tail].sum()), float(f["volume"][tail].sum()),
            ))
        if new:
            if self.sums.exists():
                new = merged(self.sums.get(), new)
            else:
                self.handle.registerTimer(end)
            self.sums.update(new)
        if late:
            yield self.frame(mint, start, [None] * 5 + [late] + [None] * 4, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, p0, _, _, p1, high, low, volume, trades, buys, sells, bought, quote, tail = self.sums.get()
        self.sums.clear()
        yield self.frame(*map(int, key[0].split(":")), [p0, high, low, p1, volume, trades, buys, sells, bought, quote / tail if tail else p1], False)

    def frame(self, mint, start, values, late) -> pd.DataFrame:
        return pd.DataFrame([(mint, start // 1000, *values, late)], columns=[c.split()[0] for c in BAR.split(", ")]).astype(object)

    def close(self) -> None:
        pass


def merged(a: tuple | None, b: tuple) -> tuple:
    """Sums of a bar from two parts of its rows, in any order."""
    if a is None:
        return b
    first, last = min(a[:3], b[:3]), max(a[3:6], b[3:6])
    return (*first, *last, max(a[6], b[6]), min(a[7], b[7]), *(x + y for x, y in zip(a[8:], b[8:])))


def bars(stream: DataFrame, seconds: int, tail: int, lateness: str) -> DataFrame:
    """Bars of a stream of swaps (mint, is_buy, volume, price, t, seq, and ms, t in whole milliseconds), each emitted once, when the watermark passes its end.

    Rows of a bar that is closed don't change it: they come out as a row of that bar with late = true and their number in `trades`. Open and
    close are by (t, seq). A mint's bars are keys of their own, so a hot mint is many groups. Rows without a mint only move the watermark; null
    prices and volumes must be filtered out before.
    """
    width = 1000 * seconds
    rows = stream.withColumn("_ts", F.timestamp_millis("ms")).withWatermark("_ts", lateness).withColumn("ms", F.unix_millis("_ts"))
    bar = F.concat_ws(":", F.col("mint").cast("long"), (F.floor(F.col("ms") / width) * width).cast("long"))
    key = F.when(F.col("mint").isNotNull() & F.col("ms").isNotNull(), bar).otherwise(NO_KEY).alias("key")
    rows = rows.select(key, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("ms", "t", "seq", "is_buy", "volume", "price")])
    return rows.groupBy("key").transformWithStateInPandas(_Bars(1000 * tail, width), BAR, "Append", "EventTime")


def vpin(bar_rows: DataFrame, least: int) -> DataFrame:
    """Mean imbalance of a mint's bars with at least `least` trades."""
    own = bar_rows.where(~F.col("late") & (F.col("trades") >= least))
    return own.groupBy("mint").agg(F.avg(F.try_divide(F.abs(2 * F.col("buy_volume") - F.col("volume")), "volume")).alias("vpin"), F.count("*").alias("buckets"))


class Liveness(Fold):
    """running when a key's first row comes or one after a pause, idle after `idle` seconds without a row, evicted, and forgotten, after `evict`."""

    schema = "status string, at_ms long, last_ms long, last_value double, rows long"

    def __init__(self, key: str, ms: str, value: str, idle: int, evict: int):
        self.key, self.ms, self.value, self.wait = key, ms, value, {"running": 1000 * idle, "idle": 1000 * evict}

    def row(self, state, row):
        old = state or {"status": "idle", "n": 0}
        new = {"key": row[self.key], "status": "running", "ms": row[self.ms], "value": row[self.value], "n": old["n"] + 1}
        return new, [self.told(new, row[self.ms])] if old["status"] == "idle" else []

    def due(self, state):
        return state["ms"] + self.wait[state["status"]]

    def expired(self, state, ms):
        if state["status"] == "running":
            state = state | {"status": "idle"}
            return state, [self.told(state, ms)]
        return None, [self.told(state | {"status": "evicted"}, ms)]

    def told(self, s, at):
        return (s["key"], s["status"], at, s["ms"], s["value"], s["n"])


class Orders(Fold):
    """Orders as their events leave them, one row for each event after the creation; `version` counts the rows.

    Kinds are created, filled, cancelled and failed. Fills before the creation don't count; an end counts unless a fill comes after it or at
    its time, and failed goes before cancelled. An order is forgotten `keep` seconds after its last event.
    """

    schema = "version long, status string, amount double, fills long, filled double, last_price double, fee double"
    RANK = ("created", "cancelled", "failed", "filled")

    def __init__(self, key: str, ms: str, keep: int):
        self.key, self.ms, self.keep = key, ms, 1000 * keep

    def row(self, state, row):
        s = dict(state or {"born": False, "amount": None, "fills": 0, "filled": 0.0, "price": None, "fee": 0.0, "ends": [], "version": 0})
        s["ms"], kind = row[self.ms], row["kind"]
        if kind == "created":
            s["born"], s["amount"] = True, row["amount"] if s["amount"] is None else max(s["amount"], row["amount"])
        elif kind in ("cancelled", "failed"):
            s["ends"] = sorted({*s["ends"], kind})
        elif s["born"]:
            s |= {"fills": s["fills"] + 1, "filled": s["filled"] + row["amount"], "price": row["price"], "fee": s["fee"] + row["fee"], "ends": []}
        if not s["born"]:
            return s, []
        s["version"] += 1
        if "failed" in s["ends"]:
            status = "FAILED"
        elif s["ends"]:
            status = "CANCELLED"
        else:
            status = "FILLED" if s["filled"] >= s["amount"] else "PARTIALLY_FILLED" if s["fills"] else "OPEN"
        return s, [(row[self.key], s["version"], status, s["amount"], s["fills"], s["filled"], s["price"], s["fee"])]

    def due(self, state):
        return state["ms"] + self.keep


class Emitted(Fold):
    """(key, t, value) of a key's first row and of each that emits(last t, last value, t, value) accepts, at most `most` of them.

    "Last" is the last row that was emitted. A key without a row for `forget` seconds is forgotten, its number of rows too; None keeps it.
    """

    def __init__(self, key: str, ms: str, t: str, value: str, emits, most: int | None = None, forget: int | None = None):
        self.names, self.ms, self.emits, self.most, self.forget = (key, t, value), ms, emits, most, forget

    def row(self, state, row):
        k, t, x = (row[c] for c in self.names)
        s = dict(state or {"last": None, "n": 0})
        s["ms"] = row[self.ms]
        if (s["last"] is None or self.emits(*s["last"], t, x)) and (self.most is None or s["n"] < self.most):
            return s | {"last": [t, x], "n": s["n"] + 1}, [(k, t, x)]
        return s, []

    def due(self, state):
        return None if self.forget is None else state["ms"] + 1000 * self.forget


def changed(share: float):
    return lambda _, last, __, x: abs(x - last) >= share * abs(last)


def apart(seconds: float):
    return lambda last, _, at, __: at - last >= seconds


def rank(kind: Column) -> Column:
    """The order of events of one order and time."""
    return F.array_position(F.array(*map(F.lit, Orders.RANK)), kind)
