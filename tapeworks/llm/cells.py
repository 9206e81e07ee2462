"""Comparing the rows of each bucket without listing its pairs.

Rows that share a bucket key are compared in cells. A bucket of up to `cell_rows` rows is one cell;
a larger one is dealt by hash into parts, and each two parts meet in a cell of their own, so a
hot bucket becomes many tasks. Within a cell only the links that join rows not yet connected
are emitted: at most one fewer than the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def deal(keyed: DataFrame, key: str, by: str, cell_rows: int) -> DataFrame:
    """Add column `cell` (long), a row for each cell that the row is compared in.

    keyed: one row for each key and distinct value of `by`, a written table. Buckets of one row are dropped.
    """
    sizes = materialize(keyed.groupBy(key).count().where("count > 1").withColumnRenamed("count", "_n"), "buckets")
    parts = F.ceil(F.col("_n") / cell_rows).cast("long")
    own = F.pmod(F.xxhash64(by, F.lit(7)), F.col("_parts"))
    return (
        keyed.join(sizes, key)
        .withColumn("_parts", parts)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        .withColumn("cell", F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other")))
        .drop("_n", "_parts", "_own", "_other")
    )


def compress(label: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := label[label], label):
        label = up
    return label


def forest(cell: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what `linked` connects, for rows sorted by cell.

    Compares each row with the next, the one after that, and so on to the end of its cell, but not
    rows that links found so far already connect.
    """
    label, out, d = np.arange(len(cell)), [], 1
    left = np.arange(len(cell))
    while len(left):
        left = left[left + d < len(cell)]
        left = left[cell[left] == cell[left + d]]
        i = left[label[left] != label[left + d]]
        if len(i):
            i = i[linked(i, i + d)]
            if len(i):
                out.append((i, i + d))
                low = np.minimum(label[i], label[i + d])
                np.minimum.at(label, label[i + d], low)
                np.minimum.at(label, label[i], low)
                label = compress(label)
        d += 1
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def whole_cells(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of whole cells (column 0), from batches sorted by cell."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cell = table.column(0).to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), 0 if cut else n
        rows = max(rows, n + 1)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def compare(dealt: DataFrame, columns: list[str], check: Callable[[pa.Table], Callable], node: str, partitions: int | None = None) -> DataFrame:
    """Links (a, b) of the rows' `node` values, as far as needed to connect them.

    check: gets a table of the columns, returns a function that tells for two index arrays which rows are linked.
    """
    at = ["cell", node, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            a, b = forest(table.column(0).to_numpy(), check(table.select(columns)))
            if len(a):
                ids = table.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    rows = dealt.select(*at)
    rows = rows.repartition(partitions, "cell") if partitions else rows.repartition("cell")
    return rows.sortWithinPartitions("cell", node).mapInArrow(run, "a long, b long")
