"""The trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from helpers import clashing, empty

from tapeworks.llm import prefix_trie

TURN = "conv_id long, turn long, role string, text string"


def slow(rows):
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100) * (1 if c >= 0 else -1)  # the remainder has the sign of c, as in SQL
        made[c] = tuple(own.get(first, [])[:h] + ts[h:])
    nodes: dict[tuple, list] = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    out = []
    for key, members in nodes.items():
        kids = [k for k in nodes if len(k) == len(key) + 1 and k[: len(key)] == key]
        under = [k for k in nodes if k[: len(key)] == key]
        leaves = [k for k in under if not any(len(m) == len(k) + 1 and m[: len(k)] == k for m in nodes)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in under if k)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(made[c]) == len(key)))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1]))


def talk(c, n, word="x", first=0):
    return [(c, t, "user" if t % 2 == 0 else "assistant", f"{word}{t}") for t in range(first, first + n)]


def test_small_trie(spark):
    rows = talk(0, 7) + talk(1, 7) + talk(2, 3) + talk(3, 9, "y") + talk(4, 1) + talk(105, 4) + talk(106, 1) + talk(207, 2, "z") + talk(-7, 3) + talk(-150, 8)
    rows += [(5, None, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (6, 3, "system", "b"), (6, 3, "system", "a"), (6, 3, None, "a"), (None, 0, "user", "lost")]
    table = spark.createDataFrame(rows, TURN)
    assert got(prefix_trie.prefix_trie(clashing(table).drop("key").withColumnRenamed("part", "parent"))) == slow(rows)
    assert prefix_trie.prefix_trie(empty(spark, TURN)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], TURN)).count() == 0


def test_copies_and_deep_paths(spark):
    """Many copies of one conversation, nested prefixes 60 turns deep, and end lists of several pieces."""
    rows = [r for c in range(300, 360) for r in talk(c, c - 299, "deep")]
    rows += [r for c in range(40_000, 40_030) for r in talk(c, 6, "copy")] + talk(50_000, 6, "copy") + talk(9_000, 6, "copy")
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURN))) == slow(rows)


def test_long_conversations_are_cut(spark, monkeypatch):
    """Slices of three turns give the same trie."""
    monkeypatch.setattr(prefix_trie, "SLICE", 3)
    rows = talk(300, 40) + talk(301, 40) + talk(302, 17) + talk(400, 9, "y") + [(400, None, "user", "null first"), (400, None, None, "null first")]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURN))) == slow(rows)


@pytest.mark.parametrize("partitions", [1, 5, 33, 1100])
def test_merges(spark, partitions):
    rows = [(c, d, 2, c == d, f"k{d % 3}-{d}", f"k{d - 1}" if d else None) for c in range(50) for d in range(c % 7)]
    table = spark.createDataFrame(rows, "conv long, d long, chars long, last boolean, key string, parent string")
    want: dict[str, list] = {}
    for c, d, *_, key, _ in rows:
        want.setdefault(key, []).append(c)
    assert {r.key: (r.conv, r.n) for r in prefix_trie.merged(table, partitions).collect()} == {k: (min(v), len(v)) for k, v in want.items()}
