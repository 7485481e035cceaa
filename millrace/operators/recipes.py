"""Runs of training recipes: the phases of a run, its log, registration and the deployment gate.

A recipe is a registered Python function ``fit(train, params) -> PipelineModel``
in place of a notebook's code, which is never executed. A run appends its phase
events to a log; everything else about it is derived from the log.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Protocol

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DEPLOYMENTS, MODEL_RUNS, PHASE_EVENTS
from ..session import Settings, settings
from ..sources import tables
from . import evaluation, notebooks, registry
from .runs import run_status, with_deployment

Fit = Callable[[DataFrame, dict], PipelineModel]
RECIPES: dict[str, Fit] = {}


def recipe(name: str) -> Callable[[Fit], Fit]:
    """Registers a recipe under a model name."""

    def add(f: Fit) -> Fit:
        RECIPES[name] = f
        return f

    return add


@recipe("default-model")
def forest(train: DataFrame, params: dict) -> PipelineModel:
    """A random forest on the vector column that ``params`` names."""
    return evaluation.train_forest(train, params.get("vector", "embedding"), params.get("label", "label"), params.get("trees", 100), params.get("depth", 5))


class Executor(Protocol):
    """What runs pipelines: ``Runner`` here; another kind can be registered."""

    def run(self, run: str, notebook: DataFrame, data: DataFrame, params: dict | None = None) -> str: ...

    def get_status(self, run: str) -> str: ...

    def cancel(self, run: str) -> bool: ...


def executor(kind: str, spark: SparkSession, root: str) -> Executor:
    """The executor of a kind: 'local' is ``Runner``; others are not built."""
    if kind != "local":
        raise NotImplementedError(f"no executor of kind {kind}")
    return Runner(spark, root)


class Stopped(Exception):
    """A run was asked to stop between two phases."""


@dataclass
class Runner:
    """Runs recipes, one at a time; its tables lie under ``root``."""

    spark: SparkSession
    root: str
    config: Settings = field(default_factory=settings)
    clock: Callable[[], datetime] = lambda: datetime.now(UTC)
    stopping: set[str] = field(default_factory=set)
    numbers: dict[str, int] = field(default_factory=dict)

    def _emit(self, run: str, phase: str, status: str, logs: str = "") -> None:
        """Appends an entry to the run's own part of the log; numbers go on where an earlier runner left them."""
        if run not in self.numbers:
            known = tables.exists(self.spark, f"{self.root}/phase_events/pipeline_id={run}")
            self.numbers[run] = (self.events(run).agg(F.max("seq")).first()[0] or 0) if known else 0
        self.numbers[run] += 1
        row = self.spark.createDataFrame([(run, self.numbers[run], phase, status, logs, self.clock())], PHASE_EVENTS)
        tables.append(row.coalesce(1), f"{self.root}/phase_events", partition_by=["pipeline_id"])

    def events(self, run: str) -> DataFrame:
        return self.spark.read.schema(PHASE_EVENTS).parquet(f"{self.root}/phase_events").filter(F.col("pipeline_id") == run)

    def get_status(self, run: str) -> str:
        if not tables.exists(self.spark, f"{self.root}/phase_events/pipeline_id={run}"):
            return "queued"
        found = run_status(self.events(run)).first()
        return found["status"] if found else "queued"

    def cancel(self, run: str) -> bool:
        """Asks a run to stop after its phase, and stops its Spark jobs."""
        self.stopping.add(run)
        self.spark.sparkContext.cancelJobGroup(run)
        return True

    def _phase(self, run: str, name: str, work: Callable[[], object]) -> object:
        if run in self.stopping:
            raise Stopped(run)
        self._emit(run, name, "running")
        out = work()
        self._emit(run, name, "success", str(out) if isinstance(out, str) else "")
        return out

    def run(self, run: str, notebook: DataFrame, data: DataFrame, params: dict | None = None) -> str:
        """One run: ``notebook`` (raw JSON, one row), ``data`` split into training and test. Gives the final status; never raises for a run's own failure."""
        params = params or {}
        self.spark.sparkContext.setJobGroup(run, f"run {run}", interruptOnCancel=True)
        try:
            parsed = self._phase(run, "download", lambda: notebooks.parse_notebooks(notebook).select("notebook.cells"))
            config = self._phase(run, "validate", lambda: self._validated(parsed))
            split = evaluation.stratified_split(data, params.get("id", "vec_id"), params.get("label", "label"))
            fit = RECIPES[config["model_name"]]
            model = self._phase(run, "execute", lambda: fit(split.filter("not is_test"), params))
            accuracy = self._phase(run, "register", lambda: self._register(run, config, model, split.filter("is_test"), params))
            gate = self.config.auto_deploy and accuracy >= self.config.deploy_threshold
            deployed = gate and self._deploy(run, config, accuracy)
            self._metrics(run, accuracy, deployed, "deployment failed" if gate and not deployed else None)
            self._emit(run, "complete", "success")
            return "success"
        except Stopped:
            self._emit(run, "shutdown", "failed", "stopped on request")
        except Exception as e:  # noqa: BLE001 - a run's failure is an entry of its log
            self._emit(run, "error", "failed", f"{type(e).__name__}: {e}"[:2000])
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return "failed"

    def _validated(self, parsed: DataFrame) -> dict:
        row = notebooks.config_of(notebooks.validate(parsed)).select("error", "model_name", "version").first()
        if row is None or row["error"]:
            raise ValueError(row["error"] if row else "no notebook")
        if row["model_name"] not in RECIPES:
            raise ValueError(f"no recipe for model {row['model_name']}")
        return row.asDict()

    def _register(self, run: str, config: dict, model: PipelineModel, test: DataFrame, params: dict) -> float:
        path = f"{self.root}/models/{config['model_name']}/{run}"
        model.write().overwrite().save(path)
        scored = evaluation.predict(model, test, params.get("vector", "embedding"))
        accuracy = evaluation.accuracy(scored, params.get("label", "label"), "prediction").first()[0] or 0.0
        tags = {"pipeline_id": run, "model_name": config["model_name"], "version": config["version"]}
        logged = {"accuracy": accuracy} | {k: float(v) for k, v in params.items() if isinstance(v, int | float)}
        tables.append(self.spark.createDataFrame([(run, "default", f"{config['model_name']}-{run[:8]}", tags, logged, path)], MODEL_RUNS), f"{self.root}/model_runs")
        return accuracy

    def _metrics(self, run: str, accuracy: float, deployed: bool, failure: str | None) -> None:
        """The run's metrics: accuracy, whether its model was deployed, and else why not."""
        row = self.spark.createDataFrame([(run, accuracy)], "id string, accuracy double")
        row = with_deployment(row, "accuracy", self.config.auto_deploy, self.config.deploy_threshold).select("id", "metrics")
        if failure:
            held = F.from_json("metrics", "map<string,string>")
            row = row.withColumn("metrics", F.to_json(F.struct(F.lit(accuracy).alias("accuracy"), F.lit(deployed).alias("deployed"), F.coalesce(F.try_element_at(held, F.lit("skip_reason")), F.lit(failure)).alias("skip_reason"))))
        tables.append(row, f"{self.root}/run_metrics")

    def metrics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/run_metrics")

    def _deploy(self, run: str, config: dict, accuracy: float) -> bool:
        """Activates the version; if that fails the run still succeeds, undeployed."""
        self._emit(run, "deploy", "running")
        try:
            path = f"{self.root}/deployments"
            old = tables.read_version(self.spark, path) if tables.versions(self.spark, path) else self.spark.createDataFrame([], DEPLOYMENTS)
            number = (old.agg(F.max("id")).first()[0] or 0) + 1
            name = config["model_name"]
            new = self.spark.createDataFrame([(number, name, config["version"], accuracy, f"{self.config.endpoint}/predict/{name}", self.clock(), True, run)], DEPLOYMENTS)
            tables.write_version(registry.activate(old, new), path)
            self._emit(run, "deploy", "success")
            return True
        except Exception as e:  # noqa: BLE001 - see above
            self._emit(run, "deploy", "failed", str(e)[:2000])
            return False

    def load(self, model_name: str) -> PipelineModel:
        """The active model of a name."""
        live = registry.with_run(tables.read_version(self.spark, f"{self.root}/deployments").filter((F.col("model_name") == model_name) & F.col("is_active")), self.spark.read.parquet(f"{self.root}/model_runs"))
        row = live.join(self.spark.read.parquet(f"{self.root}/model_runs").select("run_id", "artifact_path"), "run_id").first()
        if row is None:
            raise KeyError(model_name)
        return PipelineModel.load(row["artifact_path"])
