"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into k-gram hashes of words; each sliding window of w hashes
keeps its least one. A shared run of k + w - 1 words always shares a kept hash, so joining kept
hashes finds every shared run that long. Each meeting is then extended word by word to both
sides, and counts if the run holds a whole window of the item (`window` words, or all of a shorter item).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, private, slices
from .words import kgrams, winnow, word_hashes, words

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
#: Bytes of benchmark text up to which its fingerprints are sent to every task; beyond, they are joined by shuffle.
BROADCAST_BYTES = 16_000_000


def profiles(window: int, k: int, short: set[int]) -> list[tuple[int, int]]:
    """(k, w) of the fingerprints needed: one for whole windows, and one for each length of a short item."""
    k = min(k, window)
    return [(k, window - k + 1)] + [(n, 1) for n in sorted(short)]


def fingerprints(ws: list[bytes], prof: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions kept for all profiles; the hash also depends on k."""
    h = word_hashes(ws)
    hs, ps = [], []
    for k, w in prof:
        g = kgrams(h, k)
        p = winnow(g, w)
        hs.append(g[p] ^ np.uint64(k))
        ps.append(p)
    return np.concatenate(hs), np.concatenate(ps)


class Index:
    """The items' words and fingerprints, as sorted arrays."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, k: int):
        self.window = window
        self.items = [(i, ws) for i, text in items if (ws := words(text))]
        self.profiles = profiles(window, k, {len(ws) for _, ws in self.items if len(ws) < window})
        hs, where, pos = [], [], []
        for n, (_, ws) in enumerate(self.items):
            own = self.profiles[:1] if len(ws) >= window else [(len(ws), 1)]
            h, p = fingerprints(ws, own)
            hs.append(h)
            where.append(np.full(len(h), n))
            pos.append(p)
        h = np.concatenate([np.empty(0, np.uint64), *hs])
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate([np.empty(0, np.int64), *where])[order]
        self.pos = np.concatenate([np.empty(0, np.int64), *pos])[order]

    def find(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of ws inside occurring windows (disjoint, sorted), and the ids of their items."""
        if not ws or not len(self.hash):
            return [], set()
        h, p = fingerprints(ws, self.profiles)
        lo = np.searchsorted(self.hash, h)
        met = np.flatnonzero(self.hash[np.minimum(lo, len(self.hash) - 1)] == h)
        if not len(met):
            return [], set()
        hi = np.searchsorted(self.hash, h[met], "right")
        done: dict[tuple[int, int], int] = {}
        runs, ids = [], set()
        for at, a, b in sorted(zip(p[met].tolist(), lo[met].tolist(), hi.tolist())):
            for j in range(a, b):
                n, q = int(self.item[j]), int(self.pos[j])
                if done.get((n, at - q), -1) > at:
                    continue
                run = extend(ws, at, self.items[n][1], q)
                done[(n, at - q)] = max(run[1], at + 1)
                if run[1] - run[0] >= min(self.window, len(self.items[n][1])):
                    runs.append(run)
                    ids.add(self.items[n][0])
        return merge(runs), ids


def extend(ws: list[bytes], at: int, item: list[bytes], q: int) -> tuple[int, int]:
    """The longest run of equal words through ws[at] and item[q], as a range of ws."""
    a, i = at, q
    while a > 0 and i > 0 and ws[a - 1] == item[i - 1]:
        a, i = a - 1, i - 1
    b, i = at, q
    while b < len(ws) and i < len(item) and ws[b] == item[i]:
        b, i = b + 1, i + 1
    return a, b


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _result(doc_id, n_words: int, runs: list[tuple[int, int]], ids: set[str]) -> tuple:
    hit = sum(b - a for a, b in runs)
    names = ",".join(sorted(ids))
    return doc_id, n_words, hit, len(ids), hashlib.sha256(names.encode()).hexdigest(), hit > 0, ",".join(f"{a}:{b}" for a, b in runs)


ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.string())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def small_index(benchmark: DataFrame, window: int, k: int, limit: int):
    """The broadcast index, or None if the items' text is larger than the limit in bytes or rows."""
    size = benchmark.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size[0] or 0) > limit or size[1] > limit // 16:
        return None
    items = [(str(r[0]) if r[0] is not None else "", r[1]) for r in benchmark.select("item_id", "text").collect()]
    return benchmark.sparkSession.sparkContext.broadcast(Index(items, window, k))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: words, words inside benchmark windows, items met.

    A null or wordless text has no words and is clean; an empty benchmark leaves all clean. Items
    without words never match; repeated item ids count once, a null id as the empty string. Repeated
    document rows each get a row, also those with a null id; texts are read whole, however long; an empty table
    gives an empty one; other columns of both tables are ignored.
    """
    docs = docs.select("doc_id", "text")
    if (index := small_index(benchmark, window, k, broadcast_bytes)) is None:
        return _joined(docs, benchmark, window, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(text)
                out.append(_result(doc_id, len(ws), *ix.find(ws)))
            yield _rows(out)

    return docs.mapInArrow(run, SCHEMA)


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """The same result for a benchmark of any size: fingerprints meet in a shuffle join."""
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    items = materialize(
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").alias("item"), F.monotonically_increasing_id().alias("item_row")), "items"
    )

    def lengths(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(words(t)) for t in batch.column(0).to_pylist()], pa.int64())], ["n"])

    short = {r[0] for r in items.select("item").mapInArrow(lengths, "n long").where(f"n > 0 and n < {window}").distinct().collect()}

    def emit(batches, all_profiles: bool):
        for batch in slices(batches):
            rows, hashes = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(text)
                prof = profiles(window, k, short) if all_profiles else profiles(window, k, set()) if len(ws) >= window else [(len(ws), 1)] * bool(ws)
                if ws and prof:
                    h = np.unique(fingerprints(ws, prof)[0])
                    rows.append(np.full(len(h), row))
                    hashes.append(h.view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(hashes))], ["row", "hash"])

    left = docs.select("row", "text").mapInArrow(lambda b: emit(b, True), "row long, hash long")
    right = items.select("item_row", "item").mapInArrow(lambda b: emit(b, False), "item_row long, hash long")
    pairs = left.join(right, "hash").select("row", "item_row").distinct()
    met = pairs.join(items, "item_row").join(docs.select("row", "text"), "row").select("row", "text", "item_id", "item")

    def verify(batches):
        for batch in slices(batches):
            out = []
            for row, text, item_id, item in zip(*(c.to_pylist() for c in batch.columns)):
                runs, ids = Index([(item_id, item)], window, k).find(words(text))
                if ids:
                    out.append((row, item_id, [[a, b] for a, b in runs]))
            if out:
                r, i, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(i, pa.string()), pa.array(s, pa.list_(pa.list_(pa.int64())))], ["row", "item_id", "runs"])

    found = met.mapInArrow(verify, "row long, item_id string, runs array<array<bigint>>").groupBy("row").agg(
        F.collect_set("item_id").alias("ids"), F.flatten(F.collect_list("runs")).alias("runs")
    )

    def finish(batches):
        for batch in slices(batches):
            yield _rows([
                _result(d, len(words(t)), merge([tuple(x) for x in runs or []]), set(ids or []))
                for d, t, ids, runs in zip(*(c.to_pylist() for c in batch.columns))
            ])

    return docs.join(found, "row", "left").select("doc_id", "text", "ids", "runs").mapInArrow(finish, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without a benchmark window, all columns as they were.

    Every row is judged by its own text, whatever its doc_id: rows that share an id or have none stay or go alone.
    Null, empty and wordless texts stay; an empty benchmark leaves all. Both ways, by broadcast and by shuffle, give the same rows.
    """
    if (index := small_index(benchmark, window, k, broadcast_bytes)) is None:
        row = private(docs, "row")
        rows = numbered(docs, row)
        found = contamination(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, window, k, broadcast_bytes)
        return rows.join(found.where("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([not index.value.find(words(t))[1] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ORACLE = """
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from benchmark
), bw as (
  select distinct item_id, least(len(ws), 10) n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') g
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) i from b where len(ws) > 0)
), sizes as (select distinct n from bw
), dw as (
  select doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') g
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from d, sizes where len(ws) >= n)
), hits as (select doc_id, i, dw.n, item_id from dw join bw using (n, g)
), hw as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id
), hi as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id::varchar item_id from hits) group by doc_id
), spans as (
  select doc_id, string_agg(concat(a - 1, ':', b), ',' order by a) spans from (
    select doc_id, min(p) a, max(p) b from (
      select doc_id, p, p - row_number() over (partition by doc_id order by p) isle from (select distinct doc_id, unnest(range(i, i + n)) p from hits)) group by doc_id, isle) group by doc_id
)
select d.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 contaminated, coalesce(spans, '') spans
from d left join hw using (doc_id) left join hi using (doc_id) left join spans using (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op2_decontamination: all `documents` against all of `benchmark`."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
