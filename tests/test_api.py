from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from millrace.api import Api
from millrace.functions import display
from millrace.operators import bodies, catalog, registry, runs, serving
from millrace.operators.evaluation import train_forest
from millrace.streaming import logs

RUNS = [("a", 1, "success", "s1", datetime(2024, 1, 3)), ("b", 1, "failed", "s2", datetime(2024, 1, 2)), ("c", 2, "queued", "s3", None), ("d", 2, "queued", "s4", None), ("e", 2, "running", "s5", datetime(2024, 1, 2))]
EVENTS = [("a", n, p, "success", datetime(2024, 1, 3)) for n, p in enumerate(["download", "execute", "complete", "late"], 1)]


@pytest.fixture(scope="module")
def api(spark):
    return Api(
        spark.createDataFrame([(1, "u1", True), (2, "u2", False)], "id bigint, github_url string, is_active boolean"),
        spark.createDataFrame(RUNS, "id string, repo_id bigint, status string, commit_sha string, started_at timestamp_ntz"),
        spark.createDataFrame(EVENTS, "pipeline_id string, seq bigint, phase string, status string, ts timestamp_ntz"),
        spark.createDataFrame([(1, "m", "1", 0.8, False), (2, "m", "2", 0.9, True)], "id bigint, model_name string, version string, accuracy double, is_active boolean"),
    )


def test_pages_and_runs(api):
    page = api.page(1, 3).first()
    assert [r["id"] for r in page["items"]] == ["a", "b", "e"] and (page["total"], page["pages"], page["size"]) == (5, 2, 3)
    assert [r["id"] for r in api.page(2, 3).first()["items"]] == ["c", "d"] and api.page(9, 3).first()["items"] == []
    after, seen = None, []
    while rows := catalog.page_after(api.pipelines, after, 2).collect():
        seen += [r["id"] for r in rows]
        after = (rows[-1]["started_at"], rows[-1]["id"])
    assert seen == ["a", "b", "e", "c", "d"]
    assert [p["phase"] for p in api.find_run("a")["phases"]] == ["download", "execute", "late"] and api.find_run("c")["phases"] is None
    assert [r["phase"] for r in api.logs("a").collect()] == ["download", "execute", "complete"]
    with pytest.raises(KeyError):
        api.find_run("nobody")
    assert [r["id"] for r in api.list_repositories().collect()] == [1]


def test_rollback_and_bodies(spark, api):
    assert [(r["id"], r["is_active"]) for r in api.rollback("m", '{"version": "1"}').orderBy("id").collect()] == [(1, True), (2, False)]
    for body, error in (('{"version": "9"}', KeyError), ('{"version": 1}', ValueError), ("{", ValueError)):
        with pytest.raises(error):
            api.rollback("m", body)
    rows = spark.createDataFrame([('{"data": [[1.0]]}',), ('{"data": 5}',), ('{"data": []}',), (None,), ("",)], "body string")
    got = bodies.validated(rows, "body", "predict")
    assert [r["error"] for r in got.collect()] == [None, "data: not a valid array", None, "body is not JSON", "body is not JSON"]
    assert bodies.accepted(got).count() == 2 and bodies.refused(got).count() == 3
    assert api.ready(spark.createDataFrame([(True,), (False,)], "ok boolean")).first()["status"] == "degraded"


def test_model_server(spark, api, tmp_path):
    data = spark.createDataFrame([(i, i % 2, [float(i % 2), float(i)]) for i in range(40)], "vec_id int, label int, embedding array<double>")
    train_forest(data, "embedding", "label", trees=3).write().save(f"file://{tmp_path}/m")
    ticks = iter(datetime(2024, 1, 1, 0, n) for n in range(60))
    server = serving.ModelServer(spark, lambda: next(ticks))
    server.load("m", "1", f"file://{tmp_path}/m")
    server.load("m", "2", f"file://{tmp_path}/m")
    got = api.predict(server, "m", data, "embedding").collect()
    assert len(got) == 40 and {(r["model_name"], r["version"]) for r in got} == {("m", "2")}
    assert [tuple(r) for r in server.list().collect()] == [("m", "2", "2024-01-01T00:01:00.000000+00:00", 1)]
    with pytest.raises(KeyError):
        api.predict(server, "other", data, "embedding")
    server.unload("m")
    assert server.list().count() == 0
    with pytest.raises(KeyError):
        server.unload("m")


def test_activation_is_unique(spark, api):
    new = spark.createDataFrame([(3, "m", "3", 0.7, False), (4, "m", "4", 0.6, False)], api.deployments.schema)
    assert [(r["id"], r["is_active"]) for r in registry.activate(api.deployments, new).orderBy("id").collect()] == [(1, False), (2, False), (3, False), (4, True)]


def test_four_decimals(spark):
    values = [0.85995, 0.03125, 1.00005, 2.675, -0.00005, 0.0, 123456.78905, 1e-7, 5.0, 0.99999, 1e7 + 0.5, None]
    exact = lambda v: str(Decimal(v).quantize(Decimal("0.0001"), ROUND_HALF_UP)).replace("-0.0000", "0.0000")
    want = [None if v is None else exact(v) for v in values]
    assert want[:2] == ["0.8599", "0.0313"]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(display.fixed4(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == want


def test_follow_ends_at_a_terminal_entry(spark, tmp_path):
    rows = spark.createDataFrame([(n, datetime(2024, 1, 1), 7, p, 60.0, "") for n, p in enumerate(["view", "click", "error"])], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    rows.write.parquet(f"file://{tmp_path}/in")
    from millrace.sources import fixtures

    stream, got = fixtures.phase_events_of(logs.stream_files(spark, f"file://{tmp_path}/in", rows.schema)), []
    query = logs.follow(stream, 7, lambda b, n: got.extend(r["phase"] for r in b.collect()), f"file://{tmp_path}/state", wait=60)
    assert not query.isActive and sorted(got) == ["click", "error", "view"]
    assert [r["phase"] for r in runs.until_terminal(spark.createDataFrame([(7, 1, "error"), (7, 2, "late")], "pipeline_id int, seq int, phase string")).collect()] == ["error"]
