"""Best-fit packing by minimum bin slack.

The pieces' lengths are counted (at most `capacity` different ones, however many documents), and the
driver plans on the counts: each bin starts with the longest remaining length, and a
subset-sum over bitsets of the remaining lengths finds the combination that leaves the least slack. That
combination is used as often as the counts allow, then removed. Pieces get a rank within
their length by a distributed count, and the plan turns length and rank into a sequence and place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokens import encoder, public_path

CAPACITY = 2048
END_ID = 0
#: Pieces of a length are ranked in groups of about this many.
RANK_ROWS = 512


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the combinations with the longest length, one that fills the capacity best: length -> copies.

    reach has a bit for every total that the lengths seen so far can make; the copies of a length
    are taken in powers of two, and the states before each are kept to find the parts of the best total.
    """
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    room = capacity - first
    full, reach, steps = 1 << room, 1, []
    mask = (full << 1) - 1
    for length in lengths:
        most = min(counts[length] - (length == first), room // length)
        copies = 1
        while most > 0 and not reach & full:
            copies = min(copies, most)
            steps.append((length, copies, reach))
            reach |= reach << length * copies & mask
            most -= copies
            copies *= 2
        if reach & full:
            break
    total, out = reach.bit_length() - 1, {first: 1}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + copies
            total -= length * copies
    return out


class Plan:
    """For each length, ranges of ranks and the sequences and places they go to."""

    def __init__(self, counts: dict[int, int], capacity: int):
        counts = {k: v for k, v in counts.items() if v}
        used: dict[int, int] = dict.fromkeys(counts, 0)
        slots: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in counts}
        self.sequences = 0
        while counts:
            best = fullest(counts, capacity)
            times = min(counts[k] // n for k, n in best.items())
            place = 0
            for length, n in best.items():
                slots[length].append((used[length], self.sequences, n, place))
                used[length] += n * times
                place += n * length
                counts[length] -= n * times
                if not counts[length]:
                    del counts[length]
            self.sequences += times
        self.slots = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            start, base, copies, place = self.slots[int(length[at[0]])]
            s = np.searchsorted(start, rank[at], "right") - 1
            k = rank[at] - start[s]
            sequence[at] = base[s] + k // copies[s]
            offset[at] = place[s] + k % copies[s] * length[at[0]]
        return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token pieces of every document row.

    Only documents of more than `capacity` ids are cut; all pieces but the first are full. Null and
    empty texts are one piece with the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                a, b, piece = 0, (n - 1) % capacity + 1, 0
                while a < n:
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    a, b, piece = b, b + capacity, piece + 1
            d, p, s, n, c = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces, whose rows have different values of `_id`.

    Rows of a length are dealt by that number, so equal pieces (copies, repeated rows) don't meet in one group. Which of
    the pieces of one length goes where has no meaning. Other columns must be those of pieces().
    """
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError(f"a piece has 1 to {capacity} ids")
    spark = parts.sparkSession
    plan = spark.sparkContext.broadcast(Plan(counts, capacity))
    groups = spark.createDataFrame([(k, v // RANK_ROWS + 1) for k, v in counts.items()], "length long, _groups long")
    dealt = parts.join(F.broadcast(groups), "length").withColumn("_group", F.pmod(F.xxhash64("_id"), "_groups")).drop("_groups")
    sizes = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "ranks")
    own = Window.partitionBy("length", "_group").orderBy("_id")
    ranked = dealt.withColumn("_rank", F.row_number().over(own) - 1).join(starts, ["length", "_group"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    rows = ranked.select(*names, (F.col("_before") + F.col("_rank")).alias("_rank"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all document rows with sequence_id and offset; no sequence exceeds the capacity, none has gaps.

    Repeated rows and ids, null ids too, are packed each; whole texts however long; an empty table gives an empty one;
    other columns are ignored.
    """
    rows = pieces(docs, tokenizer, capacity, end_id).withColumn("_id", F.monotonically_increasing_id())
    return pack(materialize(rows, "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    """op4_best_fit_packing: all `documents` in sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path())
