from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import catalog, registry, runs
from millrace.schemas import PHASE_ORDER

T0 = datetime(2024, 1, 1)
EVENTS = [
    ("a", 1, "download", "running"), ("a", 2, "download", "success"), ("a", 3, "validate", "running"), ("a", 4, "error", "failed"), ("a", 5, "download", "running"),
    ("b", 6, "download", "running"), ("b", 7, "download", "success"), ("b", 8, "complete", "success"),
    ("c", 9, "download", "running"), ("c", 10, "shutdown", "failed"), ("d", 11, "other", "running"),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([(p, n, ph, s, T0 + timedelta(hours=n)) for p, n, ph, s in EVENTS], "pipeline_id string, seq bigint, phase string, status string, ts timestamp_ntz")


def test_timeline_modes(events):
    last = {(r["pipeline_id"], r["phase"]): r["status"] for r in runs.timeline(events, PHASE_ORDER).collect()}
    first = {(r["pipeline_id"], r["phase"]): r["status"] for r in runs.timeline(events, PHASE_ORDER, "first").collect()}
    assert last["b", "download"] == "success" and first["b", "download"] == "running" and last["d", "deploy"] == "pending" and len(last) == 20


def test_status(events):
    got = {r["pipeline_id"]: r["status"] for r in runs.run_status(events).collect()}
    assert got == {"a": "failed", "b": "success", "c": "failed", "d": "running"}


def test_log_views(events):
    assert runs.until_terminal(events).filter("pipeline_id = 'a'").count() == 4
    assert runs.stored_phases(events).count() == len(EVENTS) - 2
    assert [r["seq"] for r in runs.tail(events, n=2).filter("pipeline_id = 'a'").orderBy("seq").collect()] == [4, 5]
    now = F.lit(T0 + timedelta(hours=31)).cast("timestamp_ntz")
    assert {r["pipeline_id"] for r in runs.replay(events, now).collect()} == {"b", "c", "d"}


def test_fold_updates(spark):
    rows = [("a", 1, "queued", None), ("a", 2, None, 5), ("a", 3, "running", None), ("b", 1, None, None)]
    got = runs.fold_updates(spark.createDataFrame(rows, "id string, seq int, status string, n int"), "id", "seq", ["status", "n"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", "running", 5), ("b", None, None)]


def test_pages(spark):
    df = spark.createDataFrame([("1", T0), ("2", None), ("3", T0), ("0", None)], "id string, started_at timestamp_ntz")
    assert [r["id"] for r in catalog.page_of(df, 1, 4).collect()] == ["1", "3", "0", "2"]
    page = catalog.page_envelope(df, 2, 3)
    assert page.total == 4 and [r["id"] for r in page.items.collect()] == ["2"]
    for bad in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            catalog.page_of(df, *bad)


def test_latest_run(spark):
    rows = [("r1", 1, T0), ("r2", 1, T0), ("r3", 1, None), ("r4", 2, None), ("r5", 2, None)]
    df = spark.createDataFrame(rows, "id string, repo_id bigint, started_at timestamp_ntz")
    assert {r["repo_id"]: r["id"] for r in catalog.latest_run(df).collect()} == {1: "r1", 2: "r4"}
    assert {r["repo_id"]: r["id"] for r in catalog.latest_run(df, among=2).collect()} == {1: "r1"}


DEPLOYED = [(1, "m", "1", 0.9, False), (2, "m", "2", 0.9, True), (3, "m", "1", 0.8, False), (4, "n", "1", 0.9, True)]


@pytest.fixture(scope="module")
def deployed(spark):
    return spark.createDataFrame(DEPLOYED, "id bigint, model_name string, version string, accuracy double, is_active boolean")


def live(df):
    return sorted(r["id"] for r in df.filter("is_active").collect())


def test_registry(spark, deployed):
    target = spark.createDataFrame([("m", "1"), ("x", "1")], "model_name string, version string")
    assert live(registry.rollback(deployed, target)) == [1, 4]
    assert [r["model_name"] for r in registry.unknown_targets(deployed, target).collect()] == ["x"]
    new = spark.createDataFrame([(9, "n", "2", 0.95, False)], deployed.schema)
    assert live(registry.activate(deployed, new)) == [2, 9]
    assert live(registry.unregister(deployed, target.select("model_name"))) == [4]
    assert {r["id"]: r["previous"] for r in registry.previous_version(deployed).collect()} == {1: None, 2: "1", 3: "2", 4: None}
    asked = spark.createDataFrame([("m",), ("zz",)], "model_name string")
    assert {r["model_name"]: r["version"] for r in registry.resolve(asked, deployed).collect()} == {"m": "2", "zz": None}
