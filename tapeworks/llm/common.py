"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

shared_dir = shared_folder

_release: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def keeps(owner: str, release: Callable[[], None]) -> None:
    """Register what empties the lookup tables that a Python worker keeps for an operator."""
    _release[owner] = release


def claim(owner: str) -> None:
    """Called in a Python worker by an operator at work: workers outlive stages, so the others' tables go."""
    if _owner[0] != owner:
        _owner[0] = owner
        for name, release in _release.items():
            if name != owner:
                release()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage (later stages don't run Python again when an executor is lost) and lets the
    planner shuffle both sides of a later join, so that adaptive execution can split hot keys.
    The files stay until the folder is cleaned, for the returned frame is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tapeworks/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def private(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have yet, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a different number in each row, written, so that every later read gives a row the same number."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut record batches into small ones, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    i = batch.schema.get_field_index(name)
    return batch.set_column(i, batch.schema.field(i).with_type(values.type), values)
