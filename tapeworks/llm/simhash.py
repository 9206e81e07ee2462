"""SimHash near-duplicates: fingerprints that differ in few bits share a block of bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import compare, deal
from .common import claim, materialize, numbered, private, slices
from .components import components
from .words import encode

SEED = 42
#: Chance meetings of a fingerprint in the buckets of all keys, beyond which keys get longer: comparing a few is cheaper than more keys.
MEETINGS = 8
#: Blocks at most: C(8, 4) = 70 keys for a fingerprint. Buckets that are still large are dealt into cells, which loses no link.
MOST_BLOCKS = 8


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits; each is set if over half the XXH64 values of the text's word shingles have it.

    ASCII letters in lower case, words split at ASCII white space, repeated shingles count each time.
    Fewer words than a shingle make one; none give 0.
    """
    ws = encode(text).lower().split()
    if not ws:
        return 0
    flat = b" ".join(ws)
    if len(ws) <= shingle:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    bits = h.astype(">u8").view(np.uint8).reshape(len(h), 8)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(bits[i : i + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The long columns `ids` and fp, the fingerprint as a signed long, of each document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(len(ids)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(c.cast(pa.int64()) for c in batch.columns[:-1]), pa.array(fp.view(np.int64))], [*ids, "fp"])

    return docs.select(*ids, "text").mapInArrow(run, ", ".join(f"`{c}` long" for c in (*ids, "fp")))


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks over 64 bits: of `blocks` blocks, at least blocks - distance are equal in a close pair."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def enough_blocks(rows: int, distance: int = 4) -> int:
    """The least number of blocks that gives a fingerprint at most MEETINGS chance meetings, about, among so many rows.

    More blocks make more keys, each of more bits, so buckets stay small as tables grow; the links found are the same. The
    keys of a fingerprint are bounded: beyond MOST_BLOCKS (or two more than `distance`) blocks it is the buckets that grow,
    with 8 blocks of 64 bits to 23 fingerprints each among 10^11.
    """
    blocks = distance + 2
    while blocks < MOST_BLOCKS and comb(blocks, distance) * rows > MEETINGS << 64 * (blocks - distance) // blocks:
        blocks += 1
    return blocks


def classes(prints: DataFrame, distance: int = 4, blocks: int | None = None, cell_rows: int = 2000) -> DataFrame:
    """(fp, part): the least fingerprint that each distinct one of a written table of `fp` reaches by links.

    Fingerprints that differ in at most `distance` bits are linked. With `blocks` blocks (default: enough_blocks) a close
    pair agrees in `blocks - distance` of them, so every choice of so many is a key; copies are collapsed first.
    """
    fps = materialize(prints.select("fp").distinct(), "fingerprints")
    blocks = blocks or enough_blocks(fps.count(), distance)
    if not distance < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    masks = block_masks(distance, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)]))
    keyed = fps.select("fp", keys.alias("x")).select("fp", F.xxhash64("x.t", "x.k").alias("key"))

    def check(table: pa.Table):
        fp = table.column(0).to_numpy().view(np.uint64)
        return lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= distance

    links = compare(deal(keyed.withColumn("node", F.col("fp")), "key", "fp", cell_rows), ["fp"], check, "node")
    parts = components(links)
    return materialize(fps.join(parts, fps.fp == parts.node, "left").select("fp", F.coalesce("component", "fp").alias("part")), "parts")


def near_groups(prints: DataFrame, distance: int = 4, blocks: int | None = None, cell_rows: int = 2000) -> DataFrame:
    """The rows of `prints` (doc_id, fp and others), a written table, with component_id.

    A null doc_id never names a group unless all of its members are null; repeated ids keep a row each.
    """
    parts = classes(prints, distance, blocks, cell_rows)
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "least")
    named = materialize(reps.join(parts, "fp"), "named")
    least = materialize(named.groupBy("part").agg(F.min("rep").alias("component_id")), "least")
    final = materialize(named.join(least, "part").select("fp", "component_id"), "groups")
    return prints.join(final, "fp").select(*prints.columns, "component_id")


def simhash_groups(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per document row: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint zero and are linked like others; texts are read whole, however long.
    Repeated rows and ids each get a row, null ids too; other columns are ignored; an empty table gives an empty one.
    """
    prints = materialize(fingerprints(docs, shingle), "prints")
    out = near_groups(prints, distance, blocks)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int | None = None) -> DataFrame:
    """The documents whose doc_id is the least of their group, all columns as they were.

    Every row is judged by its own text: it goes if its group has a lesser doc_id. A row of another group stays, also if it
    shares the doc_id of one that goes. Rows with a null doc_id can't be named and are kept; of rows that repeat the kept
    doc_id all stay. Null, empty and blank texts are one group; an empty table gives an empty one.
    """
    row = private(docs, "row")
    rows = numbered(docs, row)
    prints = materialize(fingerprints(rows, shingle, (row, "doc_id")), "prints")
    gone = near_groups(prints, distance, blocks).where("doc_id <> component_id").select(row)
    return rows.join(materialize(gone, "gone"), row, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op5_simhash_dedup: all `documents`."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
