"""Model deployments: activate, roll back, unregister, resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def activate(deployments: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` deployments become the active ones of their models; of several of one model the newest id."""
    named = new.select("model_name", F.lit(True).alias("_replaced")).distinct()
    newest = new.groupBy("model_name").agg(F.max("id").alias("_newest"))
    kept = deployments.join(named, "model_name", "left").withColumn("is_active", F.col("is_active") & F.col("_replaced").isNull()).select(*deployments.columns)
    live = new.join(newest, "model_name").withColumn("is_active", F.col("id") == F.col("_newest"))
    return kept.unionByName(live.select(*deployments.columns))


def rollback(deployments: DataFrame, targets: DataFrame) -> DataFrame:
    """Activates ``targets`` (model_name, version) and deactivates the models' others; of equal versions the smallest id.

    Models whose version is unknown stay as they are; ``unknown_targets`` lists them.
    """
    at = deployments.join(targets, ["model_name", "version"]).groupBy("model_name").agg(F.min("id").alias("_target"))
    return deployments.join(at, "model_name", "left").withColumn("is_active", F.when(F.col("_target").isNotNull(), F.col("id") == F.col("_target")).otherwise(F.col("is_active"))).select(*deployments.columns)


def unknown_targets(deployments: DataFrame, targets: DataFrame) -> DataFrame:
    return targets.join(deployments, ["model_name", "version"], "left_anti")


def unregister(deployments: DataFrame, models: DataFrame) -> DataFrame:
    """No deployment of ``models`` (model_name) is active any more."""
    gone = models.select("model_name").distinct().withColumn("_gone", F.lit(True))
    return deployments.join(gone, "model_name", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).select(*deployments.columns)


def previous_version(deployments: DataFrame) -> DataFrame:
    """``previous``: the version deployed before, by model."""
    return deployments.withColumn("previous", F.lag("version").over(Window.partitionBy("model_name").orderBy("id")))


def resolve(requests: DataFrame, deployments: DataFrame) -> DataFrame:
    """Requests (model_name) with the active version; null where there is none."""
    live = deployments.filter("is_active").groupBy("model_name").agg(F.max_by("version", "id").alias("version"))
    return requests.join(live, "model_name", "left")


def with_run(deployments: DataFrame, model_runs: DataFrame) -> DataFrame:
    """Deployments with the tracking run that their pipeline's tag names."""
    runs = model_runs.select("run_id", F.col("tags")["pipeline_id"].alias("pipeline_id"))
    return deployments.join(runs, "pipeline_id", "left")


def request_counts(requests: DataFrame) -> DataFrame:
    """Successful requests by model."""
    return requests.filter("ok").groupBy("model_name").agg(F.count(F.lit(1)).alias("requests"))
