"""Stateful streams and recurrences against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from test_queries import SF, swaps

from tapeworks.operators import recurrences, tape
from tapeworks.plans import registry
from tapeworks.sources import views
from tapeworks.streaming import streams


def test_stream_changes(spark):
    want = []
    for mint, rows in swaps(spark).items():
        last = None
        for r in sorted(rows, key=lambda r: (r.t, r.price)):
            if last is None or abs(r.price - last) >= 0.3 * last:
                want.append((mint, r.t, last := r.price))
    assert sorted(map(tuple, registry.QUERIES["stream_changes"](spark, SF).select("mint", "t", "price").collect())) == sorted(want)


def test_stream_rate_limited(spark):
    want = []
    for mint, rows in swaps(spark).items():
        last = -math.inf
        for r in sorted(rows, key=lambda r: (r.t, r.volume)):
            if not r.is_buy and r.volume >= 20 and r.t - last >= 3600:
                want.append((mint, last := r.t, r.volume))
    got = sorted(map(tuple, registry.QUERIES["stream_rate_limited"](spark, SF).select("mint", "t", "volume").collect()))
    assert got == sorted(want) and got


def test_streams_keep_state_between_batches(spark, tmp_path):
    schema = "k long, t double, x double, other string"
    for i, part in enumerate([[(1, 0.0, 1.0, "a"), (1, 1.0, 1.1, "a"), (None, 1.0, 1.0, "a"), (2, 0.0, None, "a")], [(1, 2.0, 1.5, "a"), (1, 3.0, 1.6, "a")], []]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, streams.drained(streams.changes(stream, "k", "t", "x", 0.3)).collect())) == [(1, 0.0, 1.0), (1, 2.0, 1.5)]


def test_new_highs(spark):
    want = {}
    for mint, rows in swaps(spark).items():
        prices = [r.price for r in sorted(rows, key=lambda r: (r.t, r.price))]
        high, want[mint] = prices[0], 0
        for x in prices:
            if x > high * 1.05:
                high, want[mint] = x, want[mint] + 1
    assert dict(map(tuple, tape.new_highs(views.swaps(spark, SF)).select("mint", "new_highs").collect())) == want


def test_new_highs_collects_rising_rows_only(spark, monkeypatch):
    """Of a mint's rows only those above all before them reach the array that is folded."""
    rows = [(1, float(i), 1.0 + (i % 7) / 10) for i in range(700)] + [(2, 0.0, None), (2, 1.0, 1.0), (2, 2.0, 2.0), (3, 0.0, None)]
    table = spark.createDataFrame(rows, "mint long, t double, price double")
    assert dict(map(tuple, tape.new_highs(table).collect())) == {1: 6, 2: 1, 3: 0}
    monkeypatch.setattr(tape.F, "aggregate", lambda p, start, merge: tape.F.struct(tape.F.size(p).alias("n")))
    assert dict(map(tuple, tape.new_highs(table).collect())) == {1: 7, 2: 2, 3: 0}


def bars(spark):
    found: dict[int, list] = {}
    for r in tape.bars(views.swaps(spark, SF), 3600, 600).orderBy("bar_start").collect():
        found.setdefault(r.mint, []).append(r)
    return found


def mean_then(values, n, alpha):
    """The recurrence as weights: every output from its definition, not from the one before."""
    out = [None] * len(values)
    for i in range(n - 1, len(values)):
        k = i - n + 1
        out[i] = (1 - alpha) ** k * sum(values[:n]) / n + sum(alpha * (1 - alpha) ** (i - j) * values[j] for j in range(n, i + 1))
    return out


def test_macd(spark):
    got = {(r.mint, r.bar_start): r for r in recurrences.macd(tape.bars(views.swaps(spark, SF), 3600, 600), 5, 9, 4).collect()}
    for mint, rows in bars(spark).items():
        close = [r.close for r in rows]
        fast, slow = mean_then(close, 5, 2 / 6), mean_then(close, 9, 2 / 10)
        line = [None if b is None else a - b for a, b in zip(fast, slow)]
        mean = [None] * min(8, len(line)) + mean_then(line[8:], 4, 2 / 5)
        for r, a, b in zip(rows, line, mean):
            g = got[mint, r.bar_start]
            assert (g.macd is None) == (a is None) and (a is None or g.macd == pytest.approx(a, abs=1e-9))
            assert (g.macd_hist is None) == (b is None) and (b is None or g.macd_hist == pytest.approx(a - b, abs=1e-9))


def test_supertrend():
    n = 80
    close = 100 + np.concatenate((np.arange(n), n - 4.0 * np.arange(n // 2)))
    line, way = recurrences.supertrend_of(close + 1, close - 1, close, 10, 3.0)
    assert (way[:9] == 0).all() and np.isnan(line[:9]).all()
    assert (way[9:n] == 1).all() and (np.diff(line[9:n]) >= 0).all() and (line[9:n] < close[9:n]).all()
    assert way[-1] == -1 and line[-1] > close[-1]
    turn = np.flatnonzero(np.diff(way[9:]))
    assert len(turn) == 1


def test_atr_of_equal_bars():
    ones = np.ones(20)
    assert np.nanmax(abs(recurrences.atr(3 * ones, ones, 2 * ones, 14)[13:] - 2)) < 1e-12
    assert np.isnan(recurrences.atr(ones[:5], ones[:5], ones[:5], 14)).all()


@pytest.mark.parametrize("name", ["macd_bands_signal", "supertrend_signal", "volatility_shift"])
def test_signals_cover_all_bars(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert len(rows) == sum(map(len, bars(spark).values())) == len({(r.mint, r.bar_start) for r in rows})
    if name == "supertrend_signal":
        assert {r.signal for r in rows} <= {-1, 0, 1} and any(r.signal for r in rows)
