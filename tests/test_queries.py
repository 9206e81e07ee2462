"""Every query with SQL gives the SQL's rows; the others are compared with plain Python."""

from __future__ import annotations

import pytest
from compare import plain, same, spark_rows, sql_rows

from tapeworks.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    assert same(spark_rows(registry.QUERIES[name](spark, SF)), sql_rows(registry.ORACLES[name], SF))


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def swaps(spark):
    from tapeworks.sources import views

    tapes: dict[int, list] = {}
    for r in views.swaps(spark, SF).orderBy("t").collect():
        tapes.setdefault(r.mint, []).append(r)
    return tapes


def test_state_sampled(spark):
    want = []
    for mint, rows in swaps(spark).items():
        last = None
        for t in sorted({r.t for r in rows}, reverse=True):
            if last is None or last - t >= 6 * 3600:
                want.append((mint, t))
                last = t
    assert sorted(map(tuple, registry.QUERIES["state_sampled"](spark, SF).select("mint", "t").collect())) == sorted(want)


def test_ema(spark):
    from tapeworks.operators import tape
    from tapeworks.sources import views

    bars: dict[int, list] = {}
    for r in tape.bars(views.swaps(spark, SF), 3600, 600).orderBy("bar_start").collect():
        bars.setdefault(r.mint, []).append(r)
    want = {}
    for mint, rows in bars.items():
        value = None
        for i, r in enumerate(rows):
            if i == 11:
                value = sum(x.close for x in rows[:12]) / 12
            elif i > 11:
                value += (r.close - value) * 2 / 13
            want[mint, r.bar_start] = value
    got = {(r.mint, r.bar_start): r.ema for r in registry.QUERIES["ema"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-7))


def test_entry_without_llm(spark, monkeypatch):
    """The entry still imports and lists the other queries when the subpackage is missing."""
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("tapeworks.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tapeworks.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.QUERIES)
    assert set(entry.oracle_sql()) == set(registry.ORACLES)
    assert entry.entry(spark).count() > 0


def test_entry_with_a_dependency_missing(spark, monkeypatch):
    """A package that only the subpackage needs may be absent too."""
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("tapeworks.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.QUERIES)


def test_plain():
    assert plain(float("nan")) is None and plain((1.00000000001, True)) == (1.0, True)
