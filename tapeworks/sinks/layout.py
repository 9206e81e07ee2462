"""Tables laid out along columns that scans filter by, with a list of what each file holds, so that a scan opens few files.

The rows are dealt into files by ranges of the columns, in order, so a file holds a small range of the first column or, of one hot value,
a small range of the next. The list of files (least and greatest value of each column, rows) is written beside the data; a scan reads
it, takes the files whose ranges meet the filter, and leaves the rest to Parquet's own statistics.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most files that a scan names one by one; a wider one reads the whole folder.
NAMED = 10_000


def lay_out(rows: DataFrame, path: str, columns: list[str], files: int) -> None:
    """Write rows in about `files` files along `columns`, and the list of the files. Rows that are null in a column come first."""
    rows.repartitionByRange(files, *columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(f"{path}/data")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/data")
    held = [x for c in columns for x in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"), F.count_if(F.col(c).isNull()).alias(f"none_{c}"))]
    # null after null: a file of nulls only has no bounds and is taken by no range
    written.groupBy(F.col("_metadata.file_path").alias("file")).agg(*held, F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """What each file holds."""
    return spark.read.parquet(f"{path}/files")


def scan(spark: SparkSession, path: str, between: Mapping[str, tuple]) -> DataFrame:
    """The rows whose columns lie in the closed ranges; no row is null in one. Only files whose own ranges meet all of them are read."""
    data, files = spark.read.parquet(f"{path}/data"), files_of(spark, path)
    for c, (low, high) in between.items():
        files = files.where((F.col(f"low_{c}") <= high) & (F.col(f"high_{c}") >= low))
    names = [r.file for r in files.select("file").limit(NAMED + 1).collect()]
    if not names:
        return data.limit(0)
    if len(names) <= NAMED:
        data = spark.read.schema(data.schema).parquet(*names)
    for c, (low, high) in between.items():
        data = data.where(F.col(c).between(low, high))
    return data
