"""Queries whose rows SQL can give, and the registry."""

from __future__ import annotations

import pytest
from compare import same, spark_rows, sql_rows
from helpers import SF

from tapeworks.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    assert same(spark_rows(registry.QUERIES[name](spark, SF)), sql_rows(registry.ORACLES[name], SF))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_entry_lists_them():
    import importlib
    import sys

    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
