"""Structured Streaming operators on event streams, and how a bounded table is run through them.

Each takes a streaming DataFrame and returns one. State is kept per key by Spark and survives a lost
executor through the query's checkpoint. Late rows within the watermark count as if they were in time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import keep_last
from ..sinks import tables
from ..sources.shared import shared_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's folder or file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that its source holds now and return what it wrote.

    In append mode the file sink commits each batch once; in update mode each batch writes the keys that it
    changed, and the last row of a key counts.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/tapeworks/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "append":
        query = writer.format("parquet").start(f"{base}/rows")
    else:
        query = writer.foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")
    return keep_last(spark.read.parquet(f"{base}/rows"), keys, ["batch"]).select(*stream.columns)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark is past its time by `ttl`."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def last_seen(stream: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Per key the newest time and value and the number of rows (complete or update mode)."""
    return stream.groupBy(key).agg(F.max(t).alias("last_t"), F.max_by(value, t).alias("last_value"), F.count("*").alias("rows"))


def liveness(seen: DataFrame, now: Column | float, seconds: float) -> DataFrame:
    """What last_seen says at `now`: idle after `seconds` without a row, and the time left until then."""
    age = F.lit(now) - F.col("last_t")
    return seen.withColumns({"status": F.when(age < seconds, "running").otherwise("idle"), "remaining": F.greatest(F.lit(seconds) - age, F.lit(0.0))})


def emitted(stream: DataFrame, key: str, t: str, value: str, emits: Callable[[float, float, float, float], bool]) -> DataFrame:
    """(key, t, value) of the first row of a key, and of each that emits(last t, last value, t, value) accepts.

    "Last" is the last row that was emitted, also for a row that comes late: ordered.ordered with folds.Emitted keeps event order, and forgets keys. A key's rows of one micro-batch are put in the order of
    (t, value), so a batch of a key must fit a task: bound it by the source's maxFilesPerTrigger. Rows
    with a null key, t or value are ignored; equal rows count one after the other.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True).sort_values([t, value], kind="stable")
        last, kept = state.get if state.exists else None, []
        for at, x in zip(rows[t].tolist(), rows[value].tolist()):
            if last is None or emits(*last, at, x):
                last = (at, x)
                kept.append(last)
        if last is not None:
            state.update(last)
        yield pd.DataFrame({key: [k[0]] * len(kept), t: [a for a, _ in kept], value: [x for _, x in kept]})

    rows = stream.select(key, F.col(t).cast("double"), F.col(value).cast("double")).dropna()
    return rows.groupBy(key).applyInPandasWithState(run, rows.schema, "t double, value double", "append", GroupStateTimeout.NoTimeout)


def changes(stream: DataFrame, key: str, t: str, value: str, share: float) -> DataFrame:
    """Values that differ from the last emitted one by `share` of it or more."""
    return emitted(stream, key, t, value, lambda _, last, __, x: abs(x - last) >= share * abs(last))


def rate_limited(stream: DataFrame, key: str, t: str, value: str, seconds: float) -> DataFrame:
    """Rows at least `seconds` after the last emitted one."""
    return emitted(stream, key, t, value, lambda last, _, at, __: at - last >= seconds)


def backfill_seconds(gap: str, low: float = 60.0, high: float = 1800.0, default: float = 300.0):
    """How much to fetch for a gap: one and a half times the gap, within bounds."""
    return F.coalesce(F.least(F.greatest(1.5 * F.col(gap), F.lit(low)), F.lit(high)), F.lit(default))


def snapshots(stream: DataFrame, state: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """state() of each micro-batch's rows, written under the batch's number (column `name`).

    A batch that is run again after a failure overwrites its own folder, so each counts once.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/tapeworks/stream-{uuid.uuid4().hex}"

    def dump(batch: DataFrame, number: int) -> None:
        state(batch).write.mode("overwrite").parquet(f"{base}/rows/{name}={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(dump).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows").withColumn(name, F.col(name).cast("long"))


def routed(stream: DataFrame, topic: str, patterns: dict[str, str]) -> DataFrame:
    """Rows with the name of each handler whose pattern their topic matches; each micro-batch is handed to all handlers."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/tapeworks/stream-{uuid.uuid4().hex}"

    def hand_out(batch: DataFrame, number: int) -> None:
        to = {p: (lambda df, h=h: df.write.mode("overwrite").parquet(f"{base}/rows/handler={h}/batch={number}")) for h, p in patterns.items()}
        tables.routed(batch, topic, to)

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(hand_out).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows")
