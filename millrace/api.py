"""The platform's reads and writes as data results: pages, a run's detail and log, models, rollback.

What a web client asks of the platform, as functions of its tables; transport
is left out. A missing row is a ``KeyError``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .operators import bodies, catalog, registry, runs, serving
from .session import settings


@dataclass
class Api:
    """Over the tables of repositories, runs, phase events and deployments."""

    repositories: DataFrame
    pipelines: DataFrame
    events: DataFrame
    deployments: DataFrame

    def list_repositories(self) -> DataFrame:
        return catalog.active(self.repositories).orderBy("id")

    def page(self, page: int = 1, size: int | None = None) -> DataFrame:
        """The envelope of a page of runs, one row: items (in the page's order), total, page, size, pages."""
        found = catalog.page_envelope(self.pipelines, page, size)
        item = F.struct(*found.items.columns)
        place = F.struct(F.col("started_at").isNull().alias("late"), (-F.unix_micros(F.col("started_at").cast("timestamp"))).alias("age"), F.col("id").alias("key"), item.alias("item"))
        out = found.items.agg(F.array_sort(F.collect_list(place)).alias("items"))
        return out.select(F.col("items.item").alias("items"), F.lit(found.total).cast("bigint").alias("total"), F.lit(page).alias("page"), F.lit(found.size).alias("size"), F.lit(-(-found.total // found.size)).cast("bigint").alias("pages"))

    def run(self, run: str) -> DataFrame:
        """A run with its phases in order (empty before it starts)."""
        phases = runs.phase_list(runs.stored_phases(self.events.filter(F.col("pipeline_id") == run))).select(F.col("pipeline_id").cast("string").alias("id"), "phases")
        return catalog.by_id(self.pipelines, run).join(phases, "id", "left")

    def find_run(self, run: str) -> Row:
        row = self.run(run).first()
        if row is None:
            raise KeyError(run)
        return row

    def logs(self, run: str) -> DataFrame:
        """A run's entries up to its first terminal one, in order."""
        return runs.until_terminal(self.events.filter(F.col("pipeline_id") == run)).orderBy("seq")

    def models(self) -> DataFrame:
        return catalog.active(self.deployments).orderBy("model_name")

    def rollback(self, model_name: str, body: str) -> DataFrame:
        """The deployments after a rollback; ValueError for a bad body, KeyError for an unknown version."""
        spark = self.deployments.sparkSession
        row = bodies.validated(spark.createDataFrame([(model_name, body)], "model_name string, body string"), "body", "rollback").select("model_name", "error", F.get_json_object("body", "$.version").alias("version"))
        error = row.first()["error"]
        if error:
            raise ValueError(error)
        target = row.select("model_name", "version")
        if not registry.unknown_targets(self.deployments, target).isEmpty():
            raise KeyError(model_name)
        return registry.rollback(self.deployments, target)

    def predict(self, server: serving.ModelServer, model_name: str, rows: DataFrame, vector: str) -> DataFrame:
        """(prediction, model_name, version) by the active version; KeyError for an unknown model."""
        live = catalog.active(self.deployments).filter(F.col("model_name") == model_name).select("version").first()
        if live is None:
            raise KeyError(model_name)
        return server.predict(model_name, rows, vector).select("prediction", F.lit(model_name).alias("model_name"), F.lit(live["version"]).alias("version"))

    def ready(self, probes: DataFrame) -> DataFrame:
        """One row: whether all services are ok, and whether any model is active."""
        return probes.agg(F.bool_and("ok").alias("ok")).select(F.when(F.col("ok"), "ok").otherwise("degraded").alias("status"), F.lit("no_models" if self.models().isEmpty() else "ok").alias("models"), F.lit(settings().endpoint).alias("endpoint"))
