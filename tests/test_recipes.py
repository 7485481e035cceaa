import json
from datetime import UTC, datetime

import pytest

from millrace.operators.recipes import RECIPES, Runner, executor, forest
from millrace.schemas import REQUIRED_TAGS
from millrace.session import Settings
from millrace.sources import tables


RECIPES["toy"] = forest


def notebook(spark, tags=REQUIRED_TAGS, name="toy"):
    cells = [{"cell_type": "code", "metadata": {"tags": [t]}, "source": [f'MODEL_NAME = "{name}"\n', 'VERSION = "2"'], "outputs": []} for t in tags]
    return spark.createDataFrame([(json.dumps({"nbformat": 4, "cells": cells}),)], "raw string")


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(i, i % 2, [float(i % 2), float(i)]) for i in range(60)], "vec_id int, label int, embedding array<double>")


@pytest.fixture
def runner(spark, tmp_path):
    return Runner(spark, f"file://{tmp_path}", Settings(deploy_threshold=0.7), clock=lambda: datetime(2024, 1, 1, tzinfo=UTC))


def phases(runner, run):
    return [(r["phase"], r["status"]) for r in runner.events(run).orderBy("seq").collect()]


def test_success_deploys(spark, runner, data):
    assert runner.run("r1", notebook(spark), data, {"trees": 5}) == "success"
    done = [(p, s) for p in ("download", "validate", "execute", "register", "deploy") for s in ("running", "success")]
    assert phases(runner, "r1") == [*done, ("complete", "success")] and runner.get_status("r1") == "success"
    assert runner.run("r2", notebook(spark), data, {"trees": 5}) == "success"
    live = tables.read_version(spark, f"{runner.root}/deployments").filter("is_active").collect()
    assert [(r["model_name"], r["version"], r["pipeline_id"]) for r in live] == [("toy", "2", "r2")]
    assert runner.load("toy").stages
    with pytest.raises(KeyError):
        runner.load("none")


def test_failures(spark, runner, data):
    assert runner.run("r1", notebook(spark, REQUIRED_TAGS[1:]), data) == "failed"
    assert phases(runner, "r1")[-2:] == [("validate", "running"), ("error", "failed")] and runner.get_status("r1") == "failed"
    RECIPES["bad"] = lambda train, params: 1 / 0
    assert runner.run("r2", notebook(spark, name="bad"), data) == "failed" and phases(runner, "r2")[-1] == ("error", "failed")
    runner.cancel("r3")
    assert runner.run("r3", notebook(spark), data) == "failed" and phases(runner, "r3") == [("shutdown", "failed")]
    assert runner.get_status("unknown") == "queued"


def test_gate_keeps_weak_models_back(spark, runner, data):
    runner.config = Settings(deploy_threshold=1.01)
    assert runner.run("r1", notebook(spark), data, {"trees": 3}) == "success"
    assert "deploy" not in {p for p, _ in phases(runner, "r1")} and tables.versions(spark, f"{runner.root}/deployments") == []


def test_numbers_go_on_and_metrics_say_why(spark, runner, data):
    assert runner.run("r1", notebook(spark, tags=REQUIRED_TAGS[:2]), data) == "failed"
    again = Runner(spark, runner.root, Settings(deploy_threshold=0.7), clock=runner.clock)
    assert again.get_status("none") == "queued" and again.run("r1", notebook(spark), data, {"trees": 5}) == "success"
    numbers = [r["seq"] for r in again.events("r1").collect()]
    assert len(numbers) == len(set(numbers)) == max(numbers)
    held = json.loads(again.metrics().filter("id = 'r1'").first()["metrics"])
    assert held["deployed"] is True and held["skip_reason"] is None and held["accuracy"] >= 0.7
    off = Runner(spark, runner.root, Settings(auto_deploy=False), clock=runner.clock)
    assert off.run("r9", notebook(spark), data, {"trees": 5}) == "success"
    held = json.loads(off.metrics().filter("id = 'r9'").first()["metrics"])
    assert held["deployed"] is False and held["skip_reason"] == "auto deploy is off"
    logged = spark.read.parquet(f"{runner.root}/model_runs").filter("tags['pipeline_id'] = 'r9'").first()["metrics"]
    assert logged["trees"] == 5.0 and "accuracy" in logged


def test_unknown_models_and_executors(spark, runner, data):
    assert runner.run("r5", notebook(spark, name="nobody"), data) == "failed"
    assert "no recipe" in runner.events("r5").filter("phase = 'error'").first()["logs"]
    assert isinstance(executor("local", spark, runner.root), Runner)
    with pytest.raises(NotImplementedError):
        executor("cluster", spark, runner.root)
