"""Loaded models: a registry that follows from load, unload and predict events, and a process that holds the models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import iso
from . import evaluation

EVENTS = "seq bigint, action string, model_name string, version string, ok boolean, ts timestamp_ntz"


def loaded_models(events: DataFrame) -> DataFrame:
    """(model_name, version, loaded_at, request_count) of the models loaded now.

    ``events`` (seq, action, model_name, version, ok, ts) say 'load', 'unload' or
    'predict'. A model's last load wins; an unload after it removes it; successful
    predictions since then are counted. Two aggregations, no sort of a model's events.
    """
    last = F.max_by(F.struct("action", "version", "ts", "seq"), F.when(F.col("action").isin("load", "unload"), F.col("seq")))
    state = events.groupBy("model_name").agg(last.alias("s")).filter("s.action = 'load'")
    counts = events.filter("action = 'predict' and ok").join(state.select("model_name", F.col("s.seq").alias("since")), "model_name").filter("seq > since").groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))
    out = state.join(counts, "model_name", "left")
    return out.select("model_name", F.col("s.version").alias("version"), iso(F.col("s.ts")).alias("loaded_at"), F.coalesce("n", F.lit(0)).cast("bigint").alias("request_count"))


@dataclass
class ModelServer:
    """Holds models by name; the last load of a name wins. ``clock`` gives the time of an event."""

    spark: SparkSession
    clock: Callable
    models: dict[str, PipelineModel] = field(default_factory=dict)
    log: list[tuple] = field(default_factory=list)

    def _note(self, action: str, name: str, version: str | None = None, ok: bool = True) -> None:
        self.log.append((len(self.log) + 1, action, name, version, ok, self.clock()))

    def load(self, name: str, version: str, path: str) -> None:
        self.models[name] = PipelineModel.load(path)
        self._note("load", name, version)

    def unload(self, name: str) -> None:
        """Removes a model; KeyError if it isn't loaded."""
        del self.models[name]
        self._note("unload", name)

    def predict(self, name: str, rows: DataFrame, vector: str) -> DataFrame:
        """``rows`` with ``prediction``; KeyError for an unknown model."""
        if name not in self.models:
            raise KeyError(name)
        out = evaluation.predict(self.models[name], rows, vector)
        self._note("predict", name)
        return out

    def events(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, EVENTS)

    def list(self) -> DataFrame:
        return loaded_models(self.events())
