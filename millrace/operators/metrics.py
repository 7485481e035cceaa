"""Run metrics with keys that aren't known in advance. The long form (run, key, value) is the canonical one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_metrics(rows: DataFrame, run: str, json: str) -> DataFrame:
    """(run, key, value) of the numeric metrics of a JSON column; booleans, texts and malformed JSON have none."""
    parsed = rows.select(F.col(run).alias("run"), F.try_parse_json(json).alias("v")).filter("v is not null and schema_of_variant(v) like 'OBJECT%'")
    items = parsed.select("run", F.explode(F.map_entries(F.expr("try_cast(v as map<string, variant>)"))).alias("e"))
    numeric = F.expr("schema_of_variant(e.value)").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")
    return items.filter(numeric).select("run", F.col("e.key").alias("key"), F.expr("cast(e.value as double)").alias("value"))


def all_metrics(rows: DataFrame, run: str, json: str) -> DataFrame:
    """(run, key, value) of all metrics of a JSON column, whatever their type, as variants."""
    parsed = rows.select(F.col(run).alias("run"), F.try_parse_json(json).alias("v")).filter("v is not null and schema_of_variant(v) like 'OBJECT%'")
    return parsed.select("run", F.explode(F.map_entries(F.expr("try_cast(v as map<string, variant>)"))).alias("e")).select("run", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def metric_keys(long: DataFrame) -> DataFrame:
    return long.select("key").distinct()


def pivot_metrics(long: DataFrame, keys: list[str]) -> DataFrame:
    """A row a run, a column a key, null where a run lacks it. Keys are given, so no job is needed to find them."""
    return long.groupBy("run").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
