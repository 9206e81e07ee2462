"""A table that is patched by jobs and merged when it is read, with compaction.

The table is a folder: data/<run> holds what a job wrote, versions/<number>.json lists the runs that make up a version, oldest
first. A job writes its data, which nobody sees yet, and then publishes a version that names it, by a rename that fails if
the number is taken; it then starts again from the newer version. A job that is killed before leaves the table as it was;
a job that is run again under its name overwrites its own unpublished data, or does nothing if it was published. Old
versions can be read as long as their files are kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, at, at.getFileSystem(conf)


def versions(spark: SparkSession, table: str) -> list[int]:
    """The numbers of the published versions, ascending."""
    _, _, at, fs = _hadoop(spark, f"{table}/versions")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, table: str, version: int | None = None) -> dict:
    """The runs whose data make up a version (the newest by default), and all runs that were ever published."""
    numbers = versions(spark, table)
    number = (numbers[-1] if numbers else 0) if version is None else version
    if number == 0:
        return {"version": 0, "runs": [], "applied": []}
    text = spark.read.text(f"{table}/versions/{number:010d}.json", wholetext=True).first()[0]
    return json.loads(text) | {"version": number}


def _publish(spark: SparkSession, table: str, number: int, runs: list[str], applied: list[str]) -> bool:
    """Make version `number`; False if another job was first."""
    jvm, conf, temporary, fs = _hadoop(spark, f"{table}/versions/.{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(json.dumps({"runs": runs, "applied": applied}).encode()))
    finally:
        out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{table}/versions/{number:010d}.json")
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(temporary), fs.makeQualified(target), none)
    except Py4JJavaError as e:
        fs.delete(temporary, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def _commit(spark: SparkSession, table: str, run: str, change: Callable[[list[str]], list[str]]) -> int:
    while True:
        now = manifest(spark, table)
        if run in now["applied"]:
            return now["version"]
        if _publish(spark, table, now["version"] + 1, change(now["runs"]), [*now["applied"], run]):
            return now["version"] + 1


def patch(rows: DataFrame, table: str, run: str) -> int:
    """Add a job's rows under its name; the version that has them. Null columns of a row leave what is there."""
    spark = rows.sparkSession
    now = manifest(spark, table)
    if run in now["applied"]:
        return now["version"]
    rows.write.mode("overwrite").parquet(f"{table}/data/{run}")
    return _commit(spark, table, run, lambda runs: [*runs, run])


def read(spark: SparkSession, table: str, like: DataFrame, keys: list[str], order: list[str], version: int | None = None) -> DataFrame:
    """The table as a version leaves it: of each key and column the newest value that is not null.

    Newer runs go before older ones; within a run the columns `order` decide (a complete order of a key's rows). One combining aggregate.
    """
    return _merged(spark, table, manifest(spark, table, version)["runs"], like, keys, order)


def _merged(spark: SparkSession, table: str, runs: list[str], like: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], like.schema)
    files = spark.read.schema(like.schema).parquet(*[f"{table}/data/{run}" for run in runs])
    place = F.element_at(F.create_map(*[F.lit(x) for i, run in enumerate(runs) for x in (run, i)]), F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+)/[^/]+$", 1))
    at = F.struct(place.alias("_run"), *order)
    names = [c for c in like.columns if c not in keys]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in names]
    return files.groupBy(*keys).agg(*newest).select(*like.columns)


def compact(spark: SparkSession, table: str, like: DataFrame, keys: list[str], order: list[str], run: str) -> int:
    """Write the newest version's rows as one run that takes the place of those it was made from; runs published meanwhile stay."""
    now = manifest(spark, table)
    if run in now["applied"] or not now["runs"]:
        return now["version"]
    taken = now["runs"]
    _merged(spark, table, taken, like, keys, order).write.mode("overwrite").parquet(f"{table}/data/{run}")
    return _commit(spark, table, run, lambda runs: [run, *[r for r in runs if r not in taken]])
