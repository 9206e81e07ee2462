"""Embedding near-duplicates: all pairs with a cosine of at least a threshold, in PCA order by tiles.

Copies of a vector are collapsed. A rotation to principal axes and a k-d tree over the leading axes
are fitted on a bounded sample; neither changes which pairs are found. Vectors are grouped by
leaf, large leaves are dealt by hash, and two groups meet in a cell only if their boxes in the
leading axes are close enough. A cell compares tiles: products of the leading axes first, then
bounded by the norms of the rest, and it stops where no pair can reach the threshold. Links
are counted in place; only a forest of them leaves the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import compress, whole_cells
from .common import materialize
from .components import components

#: Vectors that the rotation and tree are fitted on (more for a tree of many leaves), and their numbers at most.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 16_000_000
#: Most vectors of a group and their numbers at most; groups that a table is dealt into at least, if they have LEAST_ROWS.
GROUP_ROWS, GROUP_VALUES, LEAST_GROUPS, LEAST_ROWS = 6000, 2_000_000, 24, 512
#: Sampled vectors for a leaf of the tree, leading axes of the boxes, vectors of a tile.
LEAF_SAMPLE, LEAD, TILE = 4, 6, 512
SLACK = 1e-9


class Space:
    """Principal axes and a k-d tree (heap order: axis and cut of each inner node)."""

    def __init__(self, sample: np.ndarray, leaves: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        _, axes = np.linalg.eigh(unit.T @ unit)
        self.axes = np.ascontiguousarray(axes[:, ::-1])
        z = (unit @ self.axes)[:, :LEAD]
        self.axis, self.cut = np.zeros(leaves, np.int64), np.zeros(leaves)
        rows = {1: z}
        for node in range(1, leaves):
            own = rows.pop(node)
            if len(own):
                self.axis[node] = a = int(own.var(axis=0).argmax())
                self.cut[node] = np.median(own[:, a])
                up = own[:, a] >= self.cut[node]
                rows[2 * node], rows[2 * node + 1] = own[~up], own[up]
            else:
                rows[2 * node] = rows[2 * node + 1] = own
        self.leaves = leaves

    def turn(self, v: np.ndarray) -> np.ndarray:
        return (v / np.linalg.norm(v, axis=1, keepdims=True)) @ self.axes

    def leaf(self, z: np.ndarray) -> np.ndarray:
        node = np.ones(len(z), np.int64)
        for _ in range(self.leaves.bit_length() - 1):
            node = 2 * node + (z[np.arange(len(z)), self.axis[node]] >= self.cut[node])
        return node


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def scaled(v: np.ndarray) -> np.ndarray:
    """The vectors times powers of two (which is exact and changes no cosine), so that their squares don't overflow."""
    return np.ldexp(v, -np.frexp(abs(v).max(axis=1, keepdims=True))[1]) if v.size else v


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while len(i):
        a, b = label[i], label[j]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        label = compress(label)
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def tile_pairs(a: np.ndarray, b: np.ndarray, rest_a: dict[int, np.ndarray], rest_b: dict[int, np.ndarray], steps: list[int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose product can reach `least`, by leading axes and then the others."""
    done, total = 0, np.zeros((len(a), len(b)))
    for step in steps:
        total += a[:, done:step] @ b[:, done:step].T
        done = step
        bound = total if step == steps[-1] else total + np.outer(rest_a[step], rest_b[step])
        may = bound >= least
        n = int(np.count_nonzero(may))
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if step != steps[-1] and n <= may.size // 200:
            i, j = np.nonzero(may)
            full = total[i, j] + np.einsum("ij,ij->i", a[i, step:], b[j, step:])
            return i[full >= least], j[full >= least]
    return np.nonzero(may)


def compare_cell(side: np.ndarray, raw: np.ndarray, copies: np.ndarray, space: Space, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked vectors of each row (copies counted), and the least row that each is connected to.

    side: 0 and 1 for the rows of two groups, or only 0 for one group, compared with itself.
    """
    z = space.turn(raw)
    norm = np.linalg.norm(raw, axis=1)
    dim = z.shape[1]
    steps = sorted({min(s, dim) for s in (8, 16, 32)} | {dim})
    rest = {s: np.linalg.norm(z[:, s:], axis=1) for s in steps}
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    if alone:
        right = left
    left, right = left[np.argsort(z[left, 0])], right[np.argsort(z[right, 0])]
    links, label = np.zeros(len(raw), np.int64), np.arange(len(raw))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    for x in range(0, len(left), TILE):
        p = left[x : x + TILE]
        for y in range(x if alone else 0, len(right), TILE):
            q = right[y : y + TILE]
            if z[q[0], 0] - z[p[-1], 0] > reach:
                break
            if z[p[0], 0] - z[q[-1], 0] > reach:
                continue
            i, j = tile_pairs(z[p], z[q], {s: r[p] for s, r in rest.items()}, {s: r[q] for s, r in rest.items()}, steps, least - SLACK)
            i, j = p[i], q[j]
            if alone and x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                cosine = np.concatenate([np.einsum("ij,ij->i", raw[i[k : k + 65536]], raw[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) / (norm[i] * norm[j])
                i, j = i[cosine >= least], j[cosine >= least]
                links += np.bincount(i, copies[j], len(raw)).astype(np.int64) + np.bincount(j, copies[i], len(raw)).astype(np.int64)
                label = unite(label, i, j)
    return links, label


def _links(reps: DataFrame, dim: int, least: float, group_rows: int) -> DataFrame:
    """(uid, n, root) partial results of all cells, for vectors of one length, a written table."""
    spark = reps.sparkSession
    rows = reps.count()
    group_rows = max(1, min(group_rows, GROUP_VALUES // dim, max(LEAST_ROWS, -(-rows // LEAST_GROUPS))))
    most = max(1, min(max(SAMPLE_ROWS, 4 * LEAF_SAMPLE * rows // group_rows), SAMPLE_VALUES // dim))
    share = F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < F.lit(min(1.0, most / max(1, rows)) * (1 << 30))
    taken = reps.where(share).select("embedding").limit(2 * most).toArrow()
    sample = vectors((taken if taken.num_rows else reps.select("embedding").limit(1).toArrow()).column(0).combine_chunks(), dim)
    leaves = 1
    while leaves * group_rows < rows and 2 * LEAF_SAMPLE * leaves <= max(len(sample), LEAF_SAMPLE):
        leaves *= 2
    space = spark.sparkContext.broadcast(Space(sample, leaves))
    lead = min(LEAD, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = space.value.turn(vectors(batch.column(2), dim))
            leaf = space.value.leaf(z[:, :LEAD])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), *(pa.array(z[:, k]) for k in range(lead))], ["uid", "copies", "embedding", "leaf", *(f"z{k}" for k in range(lead))])

    schema = f"uid long, copies long, embedding {dict(reps.dtypes)['embedding']}, leaf long" + "".join(f", z{k} double" for k in range(lead))
    placed = materialize(reps.select("uid", "copies", "embedding").mapInArrow(place, schema), "placed")
    sizes = {r[0]: r[1] for r in placed.groupBy("leaf").count().collect()}  # a row for each leaf
    parts = spark.createDataFrame([(k, -(-n // group_rows)) for k, n in sizes.items()], "leaf long, parts long")
    own = F.pmod(F.xxhash64("uid", F.lit(3)), F.col("parts"))
    grouped = materialize(placed.join(F.broadcast(parts), "leaf").withColumn("part", own).drop("parts"), "grouped")
    ends = [f(f"z{k}").alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in range(lead)]
    boxes = sorted(tuple(r) for r in grouped.groupBy("leaf", "part").agg(*ends).collect())  # a row for about group_rows vectors
    box = np.array([b[2:] for b in boxes]).reshape(len(boxes), 2, lead)
    names = np.array([b[:2] for b in boxes], np.int64).reshape(len(boxes), 2)
    shared = spark.sparkContext.broadcast((box, names))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, names = shared.value
        for batch in batches:
            for g in batch.column(0).to_pylist():
                gap = np.maximum(0, np.maximum(box[g, 0] - box[g:, 1], box[g:, 0] - box[g, 1]))
                o = g + np.flatnonzero((gap**2).sum(axis=1) <= 2 - 2 * least + SLACK)
                cell = g * len(box) + o
                side = np.concatenate([np.zeros(len(o), np.int32), np.ones(len(o) - 1, np.int32)])
                who = np.concatenate([np.full(len(o), g), o[1:]])
                yield pa.RecordBatch.from_arrays([pa.array(names[who, 0]), pa.array(names[who, 1]), pa.array(np.concatenate([cell, cell[1:]])), pa.array(side)], ["leaf", "part", "cell", "side"])

    cells = spark.range(len(boxes)).mapInArrow(meet, "leaf long, part long, cell long, side int")
    dealt = grouped.select("leaf", "part", "uid", "copies", "embedding").join(materialize(cells, "cells"), ["leaf", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches, 1):
            cell = table.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                t = table.slice(a, b - a)
                uid = t.column(2).to_numpy()
                n, label = compare_cell(t.column(1).to_numpy(), vectors(t.column(4).combine_chunks(), dim), t.column(3).to_numpy(), space.value, least)
                got = np.flatnonzero(n)
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array(uid[got]), pa.array(n[got]), pa.array(uid[label[got]])], ["uid", "n", "root"])

    rows = dealt.select("cell", "side", "uid", "copies", "embedding").repartition("cell").sortWithinPartitions("cell", "side", "uid")
    return rows.mapInArrow(run, "uid long, n long, root long")


def near_vectors(table: DataFrame, least: float = 0.9, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    n_links counts the other rows with a cosine of at least `least`, in double precision from the components as they are
    given (floats stay floats in storage only). Null, empty and zero vectors and
    those with null or non-finite components link with nothing, nor do vectors of different lengths. Repeated rows
    link with each other. A component without any vec_id has a null component_id; its rows are kept. An empty table gives an
    empty one; other columns are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("the threshold is a cosine above 0")
    kind = dict(table.dtypes)["embedding"]
    embedding = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = materialize(table.select("vec_id", embedding.alias("embedding")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.coalesce((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(whole)
    reps = materialize(good.groupBy("embedding").agg(F.min("uid").alias("uid"), F.min("vec_id").alias("vec"), F.count("*").alias("copies")), "reps")
    dims = [r[0] for r in reps.select(F.size("embedding")).distinct().collect()]
    found = None
    for dim in dims:
        own = _links(reps.where(F.size("embedding") == dim), dim, least, group_rows)
        found = own if found is None else found.union(own)
    alone = rows.where(~whole).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is None:
        return alone.withColumn("kept", F.lit(True))
    found = materialize(found, "found")
    counts = materialize(found.groupBy("uid").agg(F.sum("n").alias("n")), "counts")
    parts = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    named = materialize(
        reps.select("uid", "vec", "copies").join(parts, reps.uid == parts.node, "left").join(counts, "uid", "left")
        .select("uid", "vec", F.coalesce("component", "uid").alias("part"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")),
        "named",
    )
    low = materialize(named.groupBy("part").agg(F.min("vec").alias("component_id")), "low")
    groups = named.join(low, "part").select("uid", "n_links", "component_id")
    final = materialize(reps.select("uid", "embedding").join(groups, "uid").drop("uid"), "final")
    linked = good.join(final, "embedding").select("vec_id", "n_links", "component_id")
    out = linked.union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
with recursive v as (
  select vec_id, embedding::double[] e from embeddings
), ok as (
  select vec_id, e from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9
), reach(n, m) as (select vec_id, vec_id from v union select n, b from reach join links on m = a)
select n vec_id, coalesce((select count(*) from links where a = n), 0)::bigint n_links, min(m) component_id, n = min(m) kept from reach group by n
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op9_embedding_dedup: all `embeddings`."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
