"""Catalogue queries over repositories, runs and deployments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settings


@dataclass
class Page:
    """One page of rows, and how many there are in all."""

    items: DataFrame
    total: int
    page: int
    size: int


def newest_first() -> list[Column]:
    """Runs in the order of pages: newest start first, those not started last, then by id."""
    return [F.col("started_at").desc_nulls_last(), F.col("id")]


def page_of(runs: DataFrame, page: int = 1, size: int | None = None) -> DataFrame:
    """One page of runs; one TakeOrderedAndProject, no full sort."""
    size = settings().page_size if size is None else size
    if page < 1 or not 1 <= size <= settings().max_page_size:
        raise ValueError(f"page must be at least 1, size from 1 to {settings().max_page_size}")
    return runs.orderBy(*newest_first()).offset((page - 1) * size).limit(size)


def page_envelope(runs: DataFrame, page: int = 1, size: int | None = None) -> Page:
    items = page_of(runs, page, size)
    return Page(items, runs.count(), page, settings().page_size if size is None else size)


def page_after(runs: DataFrame, last: tuple | None = None, size: int | None = None) -> DataFrame:
    """The page after the row (started_at, id), None for the first: its cost doesn't grow with the page's number, as ``page_of``'s does."""
    size = settings().page_size if size is None else size
    if not 1 <= size <= settings().max_page_size:
        raise ValueError(f"size must be from 1 to {settings().max_page_size}")
    if last is not None:
        at, key = last
        same_or_null = F.col("started_at").isNull() & (F.col("id") > key) if at is None else F.col("started_at").isNull() | (F.col("started_at") < F.lit(at)) | ((F.col("started_at") == F.lit(at)) & (F.col("id") > key))
        runs = runs.filter(same_or_null)
    return runs.orderBy(*newest_first()).limit(size)


def by_id(df: DataFrame, key, column: str = "id") -> DataFrame:
    """The row of a key; the equality reaches the scan."""
    return df.filter(F.col(column) == key).limit(1)


def first_row(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(key).limit(1)


def active(df: DataFrame) -> DataFrame:
    return df.filter("is_active")


def with_repository(runs: DataFrame, repos: DataFrame) -> DataFrame:
    """Runs with their repository's display name; ``repo #<id>`` where it is gone. Spark picks the join by size."""
    from ..functions.strings import display_name

    names = repos.select(F.col("id").alias("_repo"), display_name(F.col("github_url")).alias("repo_name"))
    named = runs.join(names, runs["repo_id"] == names["_repo"], "left").drop("_repo")
    return named.withColumn("repo_name", F.coalesce("repo_name", F.concat(F.lit("repo #"), F.col("repo_id").cast("string"))))


def latest_run(runs: DataFrame, among: int | None = None) -> DataFrame:
    """Each repository's newest run; with ``among``, only of the newest so many runs overall.

    One aggregation; partial aggregation leaves one row a repository and task to
    shuffle.
    """
    if among is not None:
        runs = runs.orderBy(*newest_first()).limit(among)
    order = F.struct(F.col("started_at").isNull(), -F.unix_micros(F.col("started_at").cast("timestamp")), F.col("id"))
    return runs.groupBy("repo_id").agg(F.min_by(F.struct(*runs.columns), order).alias("_run")).select("_run.*")


def repositories_with_latest(repos: DataFrame, runs: DataFrame, among: int | None = None) -> DataFrame:
    last = latest_run(runs, among).select(F.col("repo_id").alias("_repo"), F.col("id").alias("run_id"), F.col("status").alias("run_status"))
    return repos.join(last, repos["id"] == last["_repo"], "left").drop("_repo")


def runs_without_repository(runs: DataFrame, repos: DataFrame) -> DataFrame:
    return runs.join(repos.select(F.col("id").alias("repo_id")), "repo_id", "left_anti")


def repositories_without_success(repos: DataFrame, runs: DataFrame) -> DataFrame:
    return repos.join(runs.filter("status = 'success'").select(F.col("repo_id").alias("id")), "id", "left_anti")
