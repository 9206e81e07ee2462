"""Tables that are written to: append, insert once by key, patch by key, and their state now.

A table is a Parquet folder. Patches are appended as they come and folded when read, so writing
never rewrites what is there. append() run again adds its rows again, and two insert_once() at once may both add a key: jobs that can be
run again or at once go through versioned.patch().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import matches


def append(rows: DataFrame, path: str) -> None:
    """Add all rows. The committer makes the rows of a job visible together or not at all."""
    rows.write.mode("append").parquet(path)


def existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at path, or an empty one with the schema of `like` while there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], like.schema)


def insert_once(rows: DataFrame, path: str, keys: list[str], order: list[Column]) -> None:
    """Add the rows whose key the table doesn't have; of rows that repeat a key the first in the order counts.

    Rows with a null in their key are never equal to others and are all added.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    first = rows.where(whole).groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")
    new = first.join(existing(rows.sparkSession, path, rows).select(*keys), keys, "left_anti").select(*rows.columns)
    append(new.unionByName(rows.where(~whole)), path)


def patched(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The state of each key: of every column the newest value that is not null (a patch leaves null columns as they were); at one time the greatest."""
    values = [c for c in events.columns if c not in (*keys, at)]
    newest = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("at"), F.col(c).alias("value"))))["value"].alias(c) for c in values]
    return events.groupBy(*keys).agg(*newest, F.max(at).alias(at))


def routed(stream_batch: DataFrame, topic: str, handlers: dict[str, Callable[[DataFrame], None]]) -> None:
    """For foreachBatch: give each handler the rows whose topic matches its pattern (`+` is one level, `#` all further ones)."""
    batch = stream_batch.persist()
    try:
        for pattern, handle in handlers.items():
            handle(batch.where(matches(F.col(topic), pattern)))
    finally:
        batch.unpersist()
