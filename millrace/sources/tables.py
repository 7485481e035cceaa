"""Storage on plain Parquet: append logs, and tables of numbered versions.

A table's state is never overwritten in place: each write makes a new version
and readers take the newest complete one, so a lost job leaves the old state.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Adds rows to a log."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _fs(spark: SparkSession, path: str):
    where = _path(spark, path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table, oldest first."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    found = []
    for s in fs.listStatus(where):
        name = s.getPath().getName()
        if re.fullmatch(r"v\d{8}", name) and fs.exists(_path(spark, f"{s.getPath().toString()}/_SUCCESS")):
            found.append(int(name[1:]))
    return sorted(found)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def write_version(df: DataFrame, path: str) -> int:
    """Writes the table's next version and gives its number."""
    n = max(versions(df.sparkSession, path), default=0) + 1
    df.write.mode("errorifexists").parquet(f"{path}/v{n:08d}")
    return n


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table, the newest by default."""
    have = versions(spark, path)
    if not have:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{version or have[-1]:08d}")


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def upsert(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``df`` with the rows of ``changes`` (one a key) in place of those with their keys; the last load wins."""
    return df.join(changes.select(key), key, "left_anti").unionByName(changes)


def register(table: DataFrame, row: DataFrame, key: str = "id") -> DataFrame:
    """A table with ``row`` added under the next key."""
    return table.unionByName(row.withColumn(key, table.agg(F.coalesce(F.max(key), F.lit(0)) + 1).scalar()).select(*table.columns))


def tolerant(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Well-formed entries of JSON lines, and the malformed lines."""
    parsed = lines.withColumn("_entry", F.from_json(column, schema)).withColumn("_ok", F.coalesce(F.schema_of_variant(F.try_parse_json(column)).startswith("OBJECT"), F.lit(False)))
    return parsed.filter("_ok").select("_entry.*"), parsed.filter("not _ok").drop("_entry", "_ok")


def read_json_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed entries of a JSON log, and the malformed lines."""
    return tolerant(spark.read.text(path), schema)
