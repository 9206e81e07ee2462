"""Archived bot databases as tables: scaled integers, renamed columns, provenance; and databases over JDBC.

An archive is a folder with one Parquet file or folder for each table of an instance: <root>/<instance>/data/<table>.parquet.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import scan

#: Amounts are stored as integers in millionths.
SCALE = 1e6
NAMES = {"market": "connector_name", "symbol": "trading_pair"}
SCALED = {
    "orders": ["amount", "price"],
    "trade_fills": ["amount", "price", "trade_fee_in_quote"],
    "positions": ["volume_traded_quote", "amount", "breakeven_price", "unrealized_pnl_quote", "cum_fees_quote"],
}


def plain(df: DataFrame, table: str) -> DataFrame:
    """An archived table with its amounts as doubles and the usual names; tables without scaled columns stay as they are."""
    rows = df.withColumns({c: F.col(c) / SCALE for c in SCALED.get(table, []) if c in df.columns})
    return rows.withColumnsRenamed({a: b for a, b in NAMES.items() if a in df.columns})


def with_cumulative_fees(fills: DataFrame, keys: list[str], order: list[str], slice_: Column) -> DataFrame:
    """Add each fill's number k in its key, the fees so far, and their step from the fill before (null for the first).

    slice_ cuts a key's order into parts that fit a task (see scans.scan).
    """
    rows = scan(fills, keys, order, slice_, {"cum_fees_in_quote": F.col("trade_fee_in_quote"), "k": F.lit(1).cast("long")})
    return rows.withColumn("trade_fee", F.when(F.col("k") > 1, F.coalesce("trade_fee_in_quote", F.lit(0.0))))


def discover(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table of all instances under root, with the instance that each row comes from."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/*/data/{table}.parquet")
    return plain(rows.withColumn("instance", instance(F.col("_metadata.file_path"))), table)


def instance(path: Column) -> Column:
    """The folder above `data` in the path of a table's file, or of a file of a table's folder."""
    return F.regexp_extract(path, r"([^/]+)/data/[^/]+(?:/[^/]+)?$", 1)


def health(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(source, status) of each table and of all: Correct if it holds a row."""
    found = None
    for name, df in tables.items():
        own = df.limit(1).agg(F.when(F.count("*") > 0, "Correct").otherwise("Error - No records matched").alias("status")).select(F.lit(name).alias("source"), "status")
        found = own if found is None else found.union(own)
    return found.groupingSets([[F.col("source")], []], "source").agg(F.when(F.bool_and(F.col("status") == "Correct"), "Correct").otherwise("Error - No records matched").alias("status"))


def jdbc(spark: SparkSession, url: str, table: str, driver: str, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table or query of a database. split: a numeric column, its bounds and the number of partitions that read it at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, driver=driver, **options)
    if split:
        column, low, high, parts = split
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()
