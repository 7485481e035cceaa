"""The platform's tables as views over the supplied Parquet tables.

Repositories come from customers, runs from orders, phase events from events,
deployments from parts, notebooks from conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = F.replace("c_name", F.lit("#"), F.lit("-"))
    url = F.concat(F.lit("https://github.com/"), F.lower("c_mktsegment"), F.lit("/"), name, F.when(F.col("c_custkey") % 7 == 0, ".git").otherwise(""))
    return c.select(F.col("c_custkey").alias("id"), url.alias("github_url"), F.when(F.col("c_custkey") % 5 == 0, "develop").otherwise("main").alias("branch"), (F.col("c_acctbal") >= 0).alias("is_active"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs; queued ones (status P) haven't started."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    key = F.col("o_orderkey").cast("string")
    return o.select(key.alias("id"), F.col("o_custkey").alias("repo_id"), status.alias("status"), F.md5(key).alias("commit_sha"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("started_at"))


def phase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phase_events_of(table(spark, sf_dir, "events"))


def phase_events_of(events: DataFrame) -> DataFrame:
    status = F.when(F.col("value") >= 50, "success").otherwise("running")
    return events.select(F.col("user_id").alias("pipeline_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("phase"), status.alias("status"), "ts")


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    newest = F.max("p_partkey").over(Window.partitionBy("p_brand"))
    accuracy = ((F.col("p_partkey") * 37) % 1000).cast("double") / 1000
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("model_name"), F.col("p_size").cast("string").alias("version"), accuracy.alias("accuracy"), (F.col("p_partkey") == newest).alias("is_active"))


def push_events(spark: SparkSession, sf_dir: str, secret: str) -> DataFrame:
    """(event_id, event_type, body, signature) of pushes to repositories; some signatures are wrong, some repositories unknown."""
    from ..functions.crypto import hmac_sha256

    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    repos = repositories(spark, sf_dir).select(F.col("id").alias("user_id"), F.regexp_replace("github_url", r"\.git$", "").alias("url"))
    e = e.join(repos, "user_id", "left")
    url = F.coalesce("url", F.lit("https://github.com/none/none"))
    file = F.when(n % 3 == 0, "notebooks/train.ipynb").when(n % 3 == 1, "src/model.py").otherwise("notebooks/train.IPYNB")
    commit = F.struct(F.md5(n.cast("string")).alias("id"), F.array(F.lit("README.md")).alias("added"), F.array(file).alias("modified"), F.array().cast("array<string>").alias("removed"))
    ref = F.concat(F.lit("refs/heads/"), F.when(n % 4 == 0, "develop").otherwise("main"))
    body = F.to_json(F.struct(ref.alias("ref"), F.md5(n.cast("string")).alias("after"), F.struct(url.alias("html_url")).alias("repository"), F.array(commit).alias("commits")))
    rows = e.select("event_id", F.when(F.col("event_type") == "error", "ping").otherwise("push").alias("event_type"), body.alias("body"))
    return rows.withColumn("signature", F.concat(F.lit("sha256="), F.when(n % 11 == 0, F.lit("0")).otherwise(hmac_sha256(F.col("body"), secret))))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(notebook_id, cell, cell_type, tags, source) from conversations: turns are cells, users' turns are code."""
    c = table(spark, sf_dir, "conversations")
    tag = F.when(F.col("turn") % 5 == 0, "mlops:config").when(F.col("turn") % 5 == 1, "mlops:preprocessing").when(F.col("turn") % 5 == 2, "mlops:training").when(F.col("turn") % 5 == 3, "mlops:export")
    return c.select(F.col("conv_id").alias("notebook_id"), F.col("turn").alias("cell"), F.when(F.col("role") == "user", "code").otherwise("markdown").alias("cell_type"), tag.alias("tag"), F.col("text").alias("source"))


def _quoted(value) -> Column:
    """A string or an array of strings as JSON."""
    whole = F.to_json(F.struct(value.alias("s")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def raw_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(notebook_id, raw): notebook files from conversations. Sources are strings or lists of lines; some files are broken or have no cells."""
    c = cells(spark, sf_dir)
    first = F.concat(F.lit('MODEL_NAME = "m-'), F.col("notebook_id").cast("string"), F.lit('"\n'))
    source = F.when(F.col("notebook_id") % 2 == 0, _quoted(F.concat(first, "source"))).otherwise(_quoted(F.array(first, F.col("source"))))
    tags = F.when(F.col("tag").isNotNull(), F.concat(F.lit('"tags":['), _quoted(F.col("tag")), F.lit("]"))).otherwise("")
    output = F.when(F.col("cell") % 2 == 0, F.concat(F.lit('{"output_type":"stream","text":'), _quoted(F.col("source")), F.lit("}"))).otherwise(F.concat(F.lit('{"output_type":"execute_result","data":{"text/plain":'), _quoted(F.col("source")), F.lit("}}")))
    cell = F.concat(F.lit('{"cell_type":"'), "cell_type", F.lit('","metadata":{'), tags, F.lit('},"source":'), source, F.lit(',"outputs":['), output, F.lit("]}"))
    held = c.select("notebook_id", F.struct("cell", cell.alias("json")).alias("x")).groupBy("notebook_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    raw = F.concat(F.lit('{"nbformat":4,"nbformat_minor":5,"cells":['), F.array_join(F.col("xs.json"), ","), F.lit("]}"))
    kind = F.col("notebook_id") % 13
    return held.select("notebook_id", F.when(kind == 5, F.substr(raw, F.lit(1), F.floor(F.length(raw) / 2).cast("int"))).when(kind == 6, '{"nbformat":4}').otherwise(raw).alias("raw"))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, status, metrics): JSON metrics of runs; numbers, booleans, texts, nulls, objects, and some texts that are no JSON object."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    number = lambda k: F.concat(F.lit("0."), F.lpad(((key * k) % 100_000).cast("string"), 5, "0"))
    forms = [
        (F.lit('{"accuracy": 0.'),), (F.lit('{"accuracy": '), number(37), F.lit(', "deployed": true}')), (F.lit('{"accuracy": '), number(41), F.lit(', "deployed": false, "skip_reason": "below"}')),
        (F.lit('{"loss": '), number(43), F.lit(', "note": "text", "trees": 100}')), (F.lit("[1, 2]"),), (F.lit('{"accuracy": "0.5", "deployed": "yes"}'),), (F.lit('{"accuracy": null, "f1": 0.25}'),),
        (F.lit('{"accuracy": '), number(47), F.lit(', "loss": '), number(53), F.lit(', "extra": {"a":1}}')),
    ]
    out = F.when(key % 8 == 0, F.concat(*forms[0]))
    for n, form in enumerate(forms[1:], 1):
        out = out.when(key % 8 == n, F.concat(*form))
    return runs(spark, sf_dir).select("id", "status").join(o.select(key.cast("string").alias("id"), out.alias("metrics")), "id")


def serving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, action, model_name, version, ok, ts) of a model server."""
    action = F.when(F.col("event_type") == "signup", "load").when(F.col("event_type") == "error", "unload").otherwise("predict")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("m-"), (F.col("user_id") % 40).cast("string")).alias("model_name"), (F.col("event_id") % 9).cast("string").alias("version"), (F.col("value") >= 20).alias("ok"), "ts")


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, tags): tracking runs of every other deployment's pipeline."""
    p = table(spark, sf_dir, "part")
    return p.select(F.md5(F.col("p_partkey").cast("string")).alias("run_id"), F.create_map(F.lit("pipeline_id"), (F.col("p_partkey") * 2).cast("string")).alias("tags"))


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, body): bodies of repository requests, valid and not."""
    bodies = ['{"github_url": "u", "branch": "main"}', '{"github_url": "u", "branch": 5}', '{"branch": "main"}', '{"github_url": null}', "[1]", '{"github_url": ', '{"github_url": 7}', '{"github_url": "u", "more": true}']
    out = F.get(F.array(*map(F.lit, bodies)), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", out.alias("body"))
