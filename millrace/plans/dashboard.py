"""The dashboard's page of runs and the repositories' cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import percent, status_style
from ..functions.strings import short
from ..functions.times import duration_text
from ..operators.catalog import page_of, with_repository


def run_page(runs: DataFrame, repos: DataFrame, now: Column, page: int = 1, size: int | None = None) -> DataFrame:
    """A page of runs as the dashboard shows it. The page is cut before the join, which so meets few rows."""
    rows = with_repository(page_of(runs, page, size), repos)
    return rows.select(
        F.col("id").alias("run_id"), short(F.col("id"), 8).alias("short_id"), "repo_name", short(F.col("commit_sha")).alias("short_sha"), "status",
        status_style(F.col("status")).alias("style"), "started_at", duration_text(F.col("started_at"), F.lit(None).cast("timestamp_ntz"), now).alias("duration"),
    )


def model_rows(deployments: DataFrame) -> DataFrame:
    """Deployments as the models page shows them."""
    return deployments.select("id", "model_name", F.concat(F.lit("v"), "version").alias("version_text"), percent(F.col("accuracy")).alias("accuracy_percent"), "is_active")


def metric_series(runs: DataFrame, long: DataFrame, repo: int, among: int | None = None) -> DataFrame:
    """(label, key, value) of the metrics of a repository's runs; ``among`` looks at the newest so many runs of all alone."""
    from ..operators.catalog import newest_first

    if among is not None:
        runs = runs.orderBy(*newest_first()).limit(among)
    mine = runs.filter(F.col("repo_id") == repo).select(F.col("id").alias("run"), short(F.col("id"), 6).alias("label"))
    return mine.join(long, "run").select("label", "key", "value")
