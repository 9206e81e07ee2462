"""Embedding whitening: exact integer sums, then centred outer products, then projection on scaled eigenvectors.

Entries are taken as integers on a fixed grid, so sums and the mean are exact whatever the order in which tasks end. Three
passes over the vectors: each task adds up its own batches (counts and sums; centred outer products by a matrix product;
outer products of the whitened rows), and the tasks' small results are merged by treeAggregate, so the driver gets a few
of them. The eigenvectors of the covariance, a matrix of dimension by dimension, are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim

#: Grid of the entries: x = floor(SCALE * c) + SHIFT. Larger entries than LARGEST don't fit a long on it.
SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0**56
#: An axis whose variance is at most this share of the total counts as flat: it can't be scaled to 1.
FLAT = 1e-12
BATCH = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding as doubles) whose vector is there, without null or non-finite entries and within the grid."""
    inside = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & inside)


def length_of(rows: DataFrame) -> int:
    """The vectors' usual length: the most frequent one, of equals the greatest; 0 for an empty table."""
    top = rows.groupBy(F.size("embedding").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()
    return top["m"]["d"] if top["m"] else 0


def grid(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of column 1 as integers."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d) + SHIFT


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, BATCH):
        yield batch.slice(i, BATCH)


def totals(rows: DataFrame, d: int, part: Callable[[np.ndarray], list[np.ndarray]], depth: int = 3) -> list[np.ndarray]:
    """Sums over all rows of the arrays that `part` makes of a batch of grid vectors.

    A task adds up its batches and emits one row; treeAggregate merges those. Integers that outgrow a long are Python's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        claim("whitening")
        held = None
        for batch in batches:
            for piece in pieces(batch):
                held = _added(held, part(grid(piece, d)))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["sums"])

    import pickle

    made = rows.mapInArrow(run, "sums binary").rdd.map(lambda r: pickle.loads(r[0]))
    return made.treeAggregate(None, _added, _added, depth)


def _added(a, b):
    if a is None or b is None:
        return b if a is None else a
    return [x + y for x, y in zip(a, b)]


class Whitener:
    """Exact n and sums S, and the scaled eigenvectors of the covariance V = sum of (x - S/n)(x - S/n)' / n."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums = n, sums
        values, axes = np.linalg.eigh(covariance)  # ascending
        trace = float(np.trace(covariance))
        self.count = min(components, len(values))
        self.values = values[::-1][: self.count]
        self.explained = self.values / trace if trace > 0 else np.full(self.count, np.nan)
        good = self.values > FLAT * trace
        self.scaled = axes[:, ::-1][:, : self.count] / np.sqrt(np.where(good, self.values, np.nan))
        self.good = good

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, exact; null where it doesn't fit a long."""
        s = np.array(self.sums, object)
        wide = np.abs(self.centred(x)).max(initial=0.0) * self.n
        if wide < 2**31 and wide * wide * x.shape[1] < 2**62 and self.n * np.abs(x).max(initial=0) < 2**62:
            off = self.n * x - s.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        off = self.n * x.astype(object) - s
        return [v if v < 2**63 else None for v in (off * off).sum(axis=1).tolist()]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n as doubles: the mean's whole part is taken off as integers, so that nothing large is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def fit(rows: DataFrame, d: int, components: int = 32) -> Whitener | None:
    """Two passes over rows of usable(): exact sums, then centred outer products. None for an empty table."""

    def sums(x: np.ndarray) -> list[np.ndarray]:
        safe = np.abs(x).max(initial=0) < 2**40
        return [len(x), x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)]

    found = totals(rows, d, sums)
    if not found:
        return None
    n, s = found[0], [int(v) for v in found[1]]

    def products(x: np.ndarray) -> list[np.ndarray]:
        z = centred(x, n, s)
        return [z.T @ z]

    return Whitener(n, s, totals(rows, d, products)[0] / n, components)


def identity_error(rows: DataFrame, d: int, model: Whitener) -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, over axes that are not flat."""
    good = np.flatnonzero(model.good)
    if not len(good):
        return None

    def sums(x: np.ndarray) -> list[np.ndarray]:
        w = model.whitened(x)[:, good]
        return [w.sum(axis=0), w.T @ w]

    mean, square = totals(rows, d, sums)
    mean = mean / model.n
    return float(np.abs(square / model.n - np.outer(mean, mean) - np.eye(len(good))).max())


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """One row per usable vector row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    A vector that is null or has a null, NaN or infinite entry (or one beyond the grid) is left out of everything, and so is one of another
    length than the most frequent (of equals the greatest). Empty vectors have no component. Rows that repeat a vec_id or a vector
    each count and are returned; null ids too; other columns are ignored. A flat axis (all vectors equal along it) has no
    scale: its whitened value is null, and it has no part in identity_error. An empty table gives an empty one.
    """
    rows = usable(vectors)
    d = length_of(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = rows.where(F.size("embedding") == d)
    model = fit(rows, d, components) if d else None
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(rows, d, model)
    sent = spark.sparkContext.broadcast(model)  # dimension x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("whitening")
        m = sent.value
        for batch in batches:
            for piece in pieces(batch):
                x, k = grid(piece, d), m.count
                ids = np.repeat(np.arange(len(x)), k)
                w = m.whitened(x).ravel()
                columns = [
                    piece.column(0).cast(pa.int64()).take(pa.array(ids)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(ids), m.n)),
                    pa.array(m.deviations(x), pa.int64()).take(pa.array(ids)), pa.array(w, mask=np.isnan(w)), pa.array(e := np.tile(m.explained, len(x)), mask=np.isnan(e)),
                    pa.array([error] * len(ids), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op13_embedding_whitening: all `embeddings`, up to 32 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
