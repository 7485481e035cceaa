from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions import arrays, display, strings, times
from millrace.operators import evaluation, metrics


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_strings(spark):
    url = "https://github.com/me/my.repo"
    assert one(spark, strings.owner_of, url) == "me" and one(spark, strings.repo_of, url) == "my"
    assert one(spark, strings.owner_of, "https://x.org/a/b") is None and one(spark, strings.owner_of, "git@github.com:me/r.git") == "me"
    assert one(spark, strings.display_name, "https://github.com/me/r.git") == "me/r" and one(spark, strings.display_name, "not a url") == "not a url"
    assert one(spark, strings.branch_of, "refs/heads/a/refs/heads/b") == "a/b" and one(spark, strings.branch_of, "refs/tags/v1") == "refs/tags/v1"
    assert one(spark, strings.mask_token, "abcdef") == "****cdef" and one(spark, strings.mask_token, "abc") == "****"
    assert one(spark, lambda c: strings.trim_or(c, "main"), "  ") == "main" and one(spark, strings.is_repo_url, "https://github.com/a/b.c/") is True


def test_times(spark):
    t = [datetime(2024, 1, 5, 15, 4, 5), datetime(2024, 1, 5, 15, 5, 4, 500000)]
    df = spark.createDataFrame([(*t, None)], "s timestamp_ntz, e timestamp_ntz, n timestamp_ntz")
    s, e, n = (F.col(c) for c in "sen")
    got = df.select(times.duration_text(s, e, e), times.duration_text(s, s, e), times.duration_text(n, e, e), times.duration_text(s, n, e), times.duration_text(e, s, e), times.date_text(s), times.date_text(n), times.iso(s), times.clock_text(s)).first()
    assert list(got) == ["1m 0s", "0s", "--", "1m 0s", "0s", "Jan 5, 03:04 PM", "--", "2024-01-05T15:04:05.000000+00:00", "3:04:05 PM"]


def test_display(spark):
    assert one(spark, display.status_style, "odd") == "gray" and one(spark, lambda c: display.log_level(c, F.lit("failed")), "complete") == "error"
    gate = lambda c: display.passes_gate(c, True, 0.7)
    assert one(spark, gate, 0.7, "double") is True and one(spark, gate, None, "double") is False
    assert one(spark, lambda c: display.skip_reason(c, True, 0.7), 0.5, "double") == "accuracy below threshold 0.70"


def test_json_and_maps(spark):
    number = lambda c: arrays.number_or(c, "accuracy", 0.0)
    assert [one(spark, number, x) for x in ('{"accuracy": 0.5}', '{"a": 1}', "{", None, '{"accuracy": "x"}')] == [0.5, 0.0, 0.0, 0.0, 0.0]
    assert one(spark, lambda c: arrays.with_entry(c, "k", F.lit("v")), {"k": "old", "a": "b"}, "map<string,string>") == {"k": "v", "a": "b"}


def test_metrics(spark):
    rows = [("r1", '{"acc": 0.9, "n": 3, "deployed": true, "note": "x"}'), ("r2", '{"n": 4}'), ("r3", "{"), ("r4", "[1]"), ("r5", None)]
    long = metrics.long_metrics(spark.createDataFrame(rows, "id string, m string"), "id", "m")
    assert sorted(tuple(r) for r in long.collect()) == [("r1", "acc", 0.9), ("r1", "n", 3.0), ("r2", "n", 4.0)]
    assert sorted(r["key"] for r in metrics.metric_keys(long).collect()) == ["acc", "n"]
    assert sorted(tuple(r) for r in metrics.pivot_metrics(long, ["acc", "n"]).collect()) == [("r1", 0.9, 3.0), ("r2", None, 4.0)]


def test_evaluation(spark):
    df = spark.createDataFrame([(i, i % 3, [float(i % 3), float(i), 1.0]) for i in range(90)], "id int, label int, v array<double>")
    split = evaluation.stratified_split(df, "id", "label")
    assert split.filter("is_test").groupBy("label").count().collect() and all(r["count"] == 6 for r in split.filter("is_test").groupBy("label").count().collect())
    stats = evaluation.scaler_stats(df, "v", 3)
    z = evaluation.scaled(df, "v", stats).agg(F.avg(F.get("v", F.lit(1))), F.stddev_pop(F.get("v", F.lit(1))), F.max(F.get("v", F.lit(2)))).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9 and z[2] == 0
    model = evaluation.train_forest(df, "v", "label", trees=5)
    scored = evaluation.predict(model, df, "v")
    assert evaluation.accuracy(scored, "label", "prediction").first()[0] > 0.9 and "features" not in scored.columns


def test_report_of_undefined_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 0)], "y int, p int")
    got = {r["label"]: r for r in evaluation.classification_report(df, "y", "p").collect()}
    assert got["1"]["recall"] == 0 and got["2"]["precision"] == 0 and abs(got["accuracy"]["f1"] - 1 / 3) < 1e-9 and got["macro avg"]["support"] == 3
