"""Order MinHash against a plain version, and what its likeness says about edits."""

from __future__ import annotations

import hashlib
import random
import re
import struct

import xxhash
from helpers import DOCUMENT, SF, clashing, documents, empty, prose

from tapeworks.llm import order_minhash, registry


def fold(*values):
    """Spark's hash of several values: each one's is the next one's seed."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v - (1 << 64) if v >> 63 == 1 else v) if abs(v) >= 2**31 else v
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def slow_print(text, k=5, sketches=64):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    if not words:
        return [0] * sketches
    seen, entries = {}, []
    for pos in range(max(1, len(words) - k + 1)):
        value = fold(*words[pos : pos + k])
        seen[value] = seen.get(value, 0) + 1
        h = xxhash.xxh64_intdigest(struct.pack("<i", seen[value]), xxhash.xxh64_intdigest(struct.pack("<Q", value), 42))
        entries.append((h, pos))
    out = []
    for i in range(sketches):
        chosen = []
        for circle in range(2):
            own = [(h, p) for h, p in entries if h >> 63 == circle]
            point = (circle * sketches + i) << 64 - (2 * sketches - 1).bit_length()
            own.sort(key=lambda e: (e[0] < point, e[0]))
            chosen += own[:1]
        chosen.sort(key=lambda e: e[1])
        seed = 42
        for h, _ in chosen:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed)
        out.append(seed & 0x7FFFFFFF)
    return out


def hexed(p):
    return "".join(f"{x:08x}" for x in p)


def slow(rows):
    """rows: (doc_id, text), of different non-null ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (c, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, n = slow_print(text), slow_print(edited), slow_print(after)
        same = lambda x, y: sum(p == q for p, q in zip(x, y)) / len(x)
        out.append((c, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), same(a, b), same(a, n)))
    return sorted(out)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, registry.QUERIES["op12_document_fingerprints"](spark, SF).collect())) == slow(docs)


def test_edges(spark):
    long = " ".join(["the same words"] * 400) + " " + prose(3000, 3)
    rows = [(1, None), (2, ""), (3, " \n\t"), (-4, "a"), (5, "two words"), (6, long), (7, prose(300, 1)), (8, prose(300, 1)), (2**62, "über ñandú 漢字 😀 five six seven"), (-(2**63), "a b a b a b a b a b a b a b a b a b a b")]
    for chars in (10, 10**9):
        made = order_minhash.fingerprints_with_next(clashing(documents(spark, rows)).withColumnRenamed("fp", "range"), task_chars=chars)
        assert sorted(map(tuple, made.collect())) == slow(rows)
    assert order_minhash.fingerprints_with_next(empty(spark, DOCUMENT)).count() == 0
    one = order_minhash.fingerprints_with_next(documents(spark, [(9, "alone in the world here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_null_and_repeated_ids(spark):
    """Equal texts have equal fingerprints; null ids come last, and every row is there once."""
    rows = [(3, "x y z"), (3, "x y z"), (3, "other text"), (None, prose(40, 5)), (None, prose(40, 6)), (1, prose(40, 5))]
    made = order_minhash.fingerprints_with_next(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_chars) for r in made if r.doc_id) == sorted((i, len(t)) for i, t in rows if i) and len(made) == 6
    prints = {r.fingerprint for r in made if r.n_chars == len(prose(40, 5))}
    assert len(prints) == 1
    assert sorted(r.near_next for r in made if r.doc_id == 3)[-1] == 1.0


def test_likeness_falls_with_edits_and_order(spark):
    """Ten changed words cost less than a hundred; the same sentences in another order are less alike than in the same one."""
    ws = prose(1000, 11).split()
    pick = random.Random(1)

    def changed(n):
        out = list(ws)
        for i in pick.sample(range(len(ws)), n):
            out[i] = "changed"
        return " ".join(out)

    parts = [ws[i : i + 100] for i in range(0, 1000, 100)]
    mixed = list(parts)
    pick.shuffle(mixed)
    texts = [" ".join(ws), changed(2), changed(20), changed(100), " ".join(w for p in mixed for w in p), prose(1000, 12)]
    made = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints_with_next(documents(spark, texts)).collect()}
    share = lambda i: sum(made[0][x : x + 8] == made[i][x : x + 8] for x in range(0, 512, 8)) / 64
    assert share(1) > share(2) > share(3) >= share(5) == 0 and share(1) > 0.85
    assert 0.2 < share(4) < 0.75
