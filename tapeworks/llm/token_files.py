"""Token-id output: documents as patched frame-of-reference blocks in files ordered by doc_id.

The files are a Parquet dataset, so that Spark's committer makes each shard whole or absent on any
store. A row is a document: shard, place of its first id in the shard, number of ids, the blocks'
bytes (see pfor) and the byte at which each block starts, so a reader gets any id without decoding
the others. Shards and the rows in them ascend by doc_id.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor
from .common import materialize, shared_dir, slices
from .tokens import encoder, public_path

#: Files up to which their totals (a row each) are sent to every task; beyond, they are joined by shuffle.
BROADCAST_FILES = 1_000_000
FILE_SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, block_starts array<int>, blocks binary"
END_ID = 0


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, percentile: float = 0.95) -> None:
    """Encode every text (null: empty), end it with end_id, and write the files to path.

    Rows with a null doc_id come first, repeated ids in any order among themselves, and many rows of one id are dealt
    to several files by their texts' hashes. An empty table gives no rows; other columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            rows, texts = [], [np.frombuffer(ids + end, "<u4") for ids in enc.encode(batch.column(1).to_pylist())]
            for ids, (data, starts) in zip(texts, pfor.write_many(texts, percentile)):
                rows.append((at, len(ids), starts, data))
                at += len(ids)
            a, n, s, d = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(n), pa.int32()), batch.column(0).cast(pa.int64()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.int32())), pa.array(d, pa.binary())],
                ["shard", "doc_id", "shard_start", "n_tokens", "block_starts", "blocks"],
            )

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text"))
    dealt.sortWithinPartitions("doc_id").mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def with_starts(files: DataFrame) -> DataFrame:
    """Add `start`: the ids of all documents before each one, from the shards' totals (a row per file)."""
    totals = materialize(files.groupBy("shard").agg(F.sum("n_tokens").alias("_n")), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if totals.count() <= BROADCAST_FILES:
        shards = F.broadcast(shards)
    return files.join(shards, "shard").withColumn("start", F.col("_before") + F.col("shard_start")).drop("_before")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, ids array<long>) of rows of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            ids = list(pfor.read_many(list(zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return files.select("doc_id", "block_starts", "blocks").mapInArrow(run, "doc_id long, ids array<bigint>")


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as decoded from the files' blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = list(pfor.read_many(list(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = with_starts(files).select("doc_id", "start", "block_starts", "blocks")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_token_files: all `documents`, written and read back."""
    path = f"{shared_dir(spark)}/tapeworks/token-files-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_path())
    return digests(read_files(spark, path))
