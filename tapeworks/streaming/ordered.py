"""Event-time operators on streams: rows released in order by the watermark, timers, state that ends, late rows apart.

Rows wait in state, by groups of keys and slices of time, until the watermark is past their time; then a fold sees them in event order, however the
input was cut into batches. A row that arrives behind the watermark is late: it does not reach the fold, but comes out
with `late` set. A fold may ask for a timer and may end its key's state. Spark keeps the state (RocksDB) and
restores it from the query's checkpoint after a failure.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..sources.shared import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The key of rows that have none.
NO_KEY = ""
#: Groups that the keys of a stream are dealt into, milliseconds of a slice of waiting rows, rows that a worker gathers before it passes them on.
GROUPS, SLICE_MS, CHUNK = 1024, 6 * 3_600_000, 20_000


class Fold:
    """What happens to a key's rows in event order. State is a JSON value, None for a key without any.

    row(state, row) takes the next row, a dict of the stream's columns, and gives the new state and the rows to emit, tuples of the output's columns.
    due(state) is the time in milliseconds at which expired(state, ms) is called unless a row changes it before; None for no timer. A state of
    None ends the key: nothing of it is kept.
    """

    def row(self, state, row: dict):
        raise NotImplementedError

    def due(self, state) -> int | None:
        return None

    def expired(self, state, ms: int):
        return None, []


class _Ordered(StatefulProcessor):
    """The rows of a group of keys wait in chunks by slice of time, with a timer at the first one's; a release folds all that the watermark has passed, slice by slice."""

    def __init__(self, fold: Fold, key: str, time: str, ties: list[str], out: list[str], slice_ms: int):
        self.fold, self.key, self.time, self.ties, self.out, self.width = fold, key, time, ties, out, slice_ms

    def init(self, handle) -> None:
        self.handle, self.passed = handle, {}
        self.held = handle.getMapState("held", "slice long, chunk long", "rows string")  # JSON arrays
        self.index = handle.getValueState("index", "value string")  # of each slice the chunks' number and the first row's time, as JSON
        self.state = handle.getValueState("state", "value string")  # of each key the fold's state and its time, as JSON

    def frame(self, rows: list[tuple], late: bool) -> pd.DataFrame:
        return pd.DataFrame([(*r, late) for r in rows], columns=[*self.out, "late"]).astype(object)

    def add(self, index: dict, slices: dict[int, list[tuple[int, str]]]) -> None:
        """A chunk of rows for each slice; rows are (ms, JSON)."""
        for i, rows in slices.items():
            n, first = index.get(str(i), (0, None))
            self.held.updateValue((i, n), ("[" + ",".join(r for _, r in rows) + "]",))
            index[str(i)] = (n + 1, min([ms for ms, _ in rows] + ([] if first is None else [first])))
        slices.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == NO_KEY:
            return
        mark, first, index, slices, n = timerValues.getCurrentWatermarkInMs(), None, None, {}, 0
        for frame in rows:
            late = []
            for ms, row in zip(frame["ms"].tolist(), frame["row"].tolist()):
                if ms <= mark:
                    late.append(row)
                else:
                    slices.setdefault(ms // self.width, []).append((ms, row))
                    first, n = ms if first is None else min(first, ms), n + 1
            if late:
                yield self.frame([tuple(json.loads(r).get(c) for c in self.out) for r in late], True)
            if n >= CHUNK:
                index, n = self.indexed() if index is None else index, 0
                self.add(index, slices)
        if first is not None:
            index = self.indexed() if index is None else index
            self.add(index, slices)
            self.index.update((json.dumps(index),))
            self.handle.registerTimer(first)

    def indexed(self) -> dict:
        return json.loads(self.index.get()[0]) if self.index.exists() else {}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The first timer that a watermark lets out does the work of all; one of an earlier release may no longer be for anything."""
        mark = timerValues.getCurrentWatermarkInMs()
        if self.passed.get(key[0]) == mark:
            return
        self.passed[key[0]] = mark
        index, out = self.indexed(), []
        before = self.state.get()[0] if self.state.exists() else None
        states = json.loads(before) if before else {}
        ready = sorted(int(i) for i, (_, first) in index.items() if first <= mark)
        for i in ready:
            rows, rest = [], []
            for n in range(index.pop(str(i))[0]):
                for r in json.loads(self.held.getValue((i, n))[0]):
                    (rows if r[self.time] <= mark else rest).append(r)
                self.held.removeKey((i, n))
            for r in sorted(rows, key=lambda r: [r[self.time], *(r[c] for c in self.ties)]):
                name = str(r[self.key])
                state, due = self.run_down(*states.get(name, (None, None)), r[self.time], out)
                state, more = self.fold.row(state, r)
                out += more
                if state is None:
                    states.pop(name, None)
                else:
                    states[name] = (state, self.fold.due(state))
                if len(out) >= CHUNK:
                    yield self.frame(out, False)
                    out = []
            if rest:
                self.add(index, {i: [(r[self.time], json.dumps(r)) for r in rest]})
        for name in [k for k, (_, due) in states.items() if due is not None and due <= mark]:
            state, due = self.run_down(*states[name], mark, out)
            if state is None:
                del states[name]
            else:
                states[name] = (state, due)
        if ready and index:
            self.index.update((json.dumps(index),))
        elif ready:
            self.index.clear()
        after = json.dumps(states) if states else None
        if after and after != before:
            self.state.update((after,))
        elif before and not after:
            self.state.clear()
        next_ = [first for _, first in index.values()] + [due for _, due in states.values() if due is not None]
        if next_:
            self.handle.registerTimer(min(next_))
        if out:
            yield self.frame(out, False)

    def run_down(self, state, due: int | None, until: int, out: list):
        """The state and its time after all of its times up to `until`."""
        while due is not None and due <= until:
            state, more = self.fold.expired(state, due)
            out += more
            due = None if state is None else self.fold.due(state)
        return state, due

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, key: str, ms: str, lateness: str, ties: list[str], fold: Fold, schema: str, groups: int = GROUPS, slice_ms: int = SLICE_MS) -> DataFrame:
    """What `fold` emits (columns of `schema`, and late = false), and late rows (their columns of the same names, late = true).

    ms: a long column, milliseconds since 1970. Rows of one millisecond go in the order of `ties`, which may not be null; other nulls are left out
    of a row's dict. A row is late if the watermark, `lateness` behind the newest row of earlier batches, has reached it. Rows without a
    key or time only move the watermark.

    Spark's state is that of `groups` groups of keys, by hash, so that keys of few rows don't each cost calls of the state; a worker holds the
    rows of a group's slice of `slice_ms` at once, and the states of a group's keys.
    """
    marked = stream.withColumn("_ts", F.timestamp_millis(ms)).withWatermark("_ts", lateness)
    group = F.when(F.col("_ts").isNotNull() & F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(groups)).cast("string"))
    # the mark's column itself stays behind, so that Spark gives late rows to the operator; JSON keeps integers beside nulls
    rows = marked.select(F.coalesce(group, F.lit(NO_KEY)).alias("key"), F.coalesce(F.unix_millis("_ts"), F.lit(0)).alias("ms"), F.to_json(F.struct(*stream.columns)).alias("row"))
    kinds = T._parse_datatype_string(schema)
    made = T.StructType([*kinds.fields, T.StructField("late", T.BooleanType())])
    return rows.groupBy("key").transformWithStateInPandas(_Ordered(fold, key, ms, ties, [f.name for f in kinds.fields], slice_ms), made, "Append", "EventTime")


def arrivals(rows: DataFrame, ms: str, number: Column, lateness_ms: int, batches: int) -> list[DataFrame]:
    """The rows in `batches` parts as they might arrive: each by up to `lateness_ms` later than its time, by a hash of `number`.

    The last part has a row of nulls but for a time beyond all, the source's heartbeat, so that a stream lets everything out.
    """
    at = rows.withColumn("_at", F.col(ms) + F.pmod(F.xxhash64(number), F.lit(lateness_ms)))
    low, high = rows.agg(F.min(ms), F.max(ms)).first()
    if low is None:
        return [rows]
    width = (high - low + lateness_ms) // batches + 1
    beat = rows.sparkSession.range(1).select(*[(F.lit(high + 10 * 365 * 86_400_000) if c == ms else F.lit(None)).cast(kind).alias(c) for c, kind in rows.dtypes])
    parts = [at.where(F.floor((F.col("_at") - low) / width) == i).drop("_at") for i in range(batches)]
    return [*parts[:-1], parts[-1].union(beat)]


def run_in_batches(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """What build(stream) emits when the parts arrive one after the other, and the folder of the stream's state.

    Every part is written to the source's folder and then read by the same query, which starts from its checkpoint each time, as after a stop.
    """
    spark = parts[0].sparkSession
    base = f"{shared_folder(spark)}/tapeworks/stream-{uuid.uuid4().hex}"
    schema, kept = parts[0].schema, spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for i, part in enumerate(parts):
            part.write.mode("overwrite").parquet(f"{base}/in/part={i}")
            stream = build(spark.readStream.schema(schema).parquet(f"{base}/in/part=*"))
            query = stream.writeStream.outputMode("append").format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{base}/state").start(f"{base}/rows")
            query.awaitTermination()
    finally:
        if kept is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, kept)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows"), f"{base}/state"


def held_state(spark: SparkSession, folder: str, name: str = "state") -> DataFrame:
    """The keys that a stream's state still has; of ordered() those that a fold has a state of."""
    rows = spark.read.format("statestore").option("stateVarName", name).load(folder)
    if name != "state":
        return rows
    keys = F.explode(F.json_object_keys("value.value"))
    return rows.select(keys.alias("key")).select(F.struct("key").alias("key"))
