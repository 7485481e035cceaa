"""The registered queries of the operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Api
from .functions import arrays, crypto, display, strings, times
from .operators import bodies, catalog, evaluation, metrics, notebooks, registry, runs, serving, webhook
from .plans import dashboard
from .schemas import REQUIRED_TAGS
from .session import Settings, settings
from .sources import fixtures as fx
from .sources import tables
from .streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_VIEWS = {
    "repos": """select c_custkey as id, concat('https://github.com/', lower(c_mktsegment), '/', replace(c_name, '#', '-'), case when c_custkey % 7 = 0 then '.git' else '' end) as github_url,
      case when c_custkey % 5 = 0 then 'develop' else 'main' end as branch, c_acctbal >= 0 as is_active from customer""",
    "runs": """select cast(o_orderkey as varchar) as id, o_custkey as repo_id, case o_orderstatus when 'F' then 'success' when 'O' then 'running' else 'queued' end as status,
      md5(cast(o_orderkey as varchar)) as commit_sha, case when o_orderstatus = 'P' then null else o_orderdate end as started_at from orders""",
    "phase_events": "select user_id as pipeline_id, event_id as seq, event_type as phase, case when value >= 50 then 'success' else 'running' end as status, ts from events",
    "deployments": """select p_partkey as id, p_brand as model_name, cast(p_size as varchar) as version, cast((p_partkey * 37) % 1000 as double) / 1000 as accuracy,
      p_partkey = max(p_partkey) over (partition by p_brand) as is_active from part""",
    "cells": """select conv_id as notebook_id, turn as cell, case when role = 'user' then 'code' else 'markdown' end as cell_type,
      case turn % 5 when 0 then 'mlops:config' when 1 then 'mlops:preprocessing' when 2 then 'mlops:training' when 3 then 'mlops:export' end as tag, text as source from conversations""",
    "run_metrics": """select cast(o_orderkey as varchar) as id, case o_orderstatus when 'F' then 'success' when 'O' then 'running' else 'queued' end as status,
      case o_orderkey % 8 when 0 then '{"accuracy": 0.' when 1 then '{"accuracy": 0.' || lpad(cast(o_orderkey * 37 % 100000 as varchar), 5, '0') || ', "deployed": true}'
        when 2 then '{"accuracy": 0.' || lpad(cast(o_orderkey * 41 % 100000 as varchar), 5, '0') || ', "deployed": false, "skip_reason": "below"}'
        when 3 then '{"loss": 0.' || lpad(cast(o_orderkey * 43 % 100000 as varchar), 5, '0') || ', "note": "text", "trees": 100}' when 4 then '[1, 2]'
        when 5 then '{"accuracy": "0.5", "deployed": "yes"}' when 6 then '{"accuracy": null, "f1": 0.25}'
        else '{"accuracy": 0.' || lpad(cast(o_orderkey * 47 % 100000 as varchar), 5, '0') || ', "loss": 0.' || lpad(cast(o_orderkey * 53 % 100000 as varchar), 5, '0') || ', "extra": {"a":1}}' end as metrics from orders""",
    "metric": """select id as run, k as key, json_type(metrics, '$.' || k) as kind, json_extract_string(metrics, '$.' || k) as text
      from (select id, metrics, unnest(json_keys(metrics)) as k from run_metrics where json_valid(metrics) and json_type(metrics) = 'OBJECT')""",
}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL over the named views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            with_ = ", ".join(f"{v} as ({_VIEWS[v]})" for v in views)
            SQL[f.__name__] = f"with {with_} {sql}" if views and not sql.lstrip().startswith("with ") else (sql.replace("with ", f"with {with_}, ", 1) if views else sql)
        return f

    return add


# Catalogue


@query("select id, github_url, branch, is_active from repos", "repos")
def scan_repositories(spark, d):
    return fx.repositories(spark, d)


@query("select * from runs where id = '7'", "runs")
def point_lookup_run(spark, d):
    return catalog.by_id(fx.runs(spark, d), "7")


@query("select model_name, version, accuracy, is_active from deployments where is_active", "deployments")
def active_deployments(spark, d):
    return catalog.active(fx.deployments(spark, d)).drop("id")


@query("select id from repos where branch = 'main' and is_active", "repos")
def conjunctive_filter(spark, d):
    return fx.repositories(spark, d).filter((F.col("branch") == "main") & F.col("is_active")).select("id")


@query("select count(*) as total from runs", "runs")
def count_runs(spark, d):
    return fx.runs(spark, d).agg(F.count(F.lit(1)).alias("total"))


@query("select * from runs order by started_at desc nulls last, id limit 20 offset 20", "runs")
def page_runs(spark, d):
    return catalog.page_of(fx.runs(spark, d), 2, 20)


@query("select * from (select * from runs where started_at is null or started_at < timestamp '1993-01-01') order by started_at desc nulls last, id limit 100 offset 1400", "runs")
def page_runs_nulls(spark, d):
    old = fx.runs(spark, d).filter("started_at is null or started_at < timestamp_ntz '1993-01-01'")
    return catalog.page_of(old, 15, 100)


_NOW = "timestamp '2000-01-01 00:00:00'"
_DURATION = """case when {s} is null then '--' else case when greatest(0, cast(floor(date_diff('millisecond', {s}, {e}) / 1000.0 + 0.5) as bigint)) < 60
  then greatest(0, cast(floor(date_diff('millisecond', {s}, {e}) / 1000.0 + 0.5) as bigint)) || 's'
  else (greatest(0, cast(floor(date_diff('millisecond', {s}, {e}) / 1000.0 + 0.5) as bigint)) // 60) || 'm ' || (greatest(0, cast(floor(date_diff('millisecond', {s}, {e}) / 1000.0 + 0.5) as bigint)) % 60) || 's' end end"""


@query(
    f"""with p as (select * from runs order by started_at desc nulls last, id limit 20)
    select p.id as run_id, substring(p.id, 1, 8) as short_id, coalesce(regexp_replace(regexp_replace(github_url, '^https://github.com/', ''), '\\.git$', ''), 'repo #' || p.repo_id) as repo_name,
    substring(commit_sha, 1, 7) as short_sha, status, case status when 'queued' then 'gray' when 'running' then 'blue' when 'success' then 'green' else 'red' end as style,
    started_at, {_DURATION.format(s="started_at", e=_NOW)} as duration from p left join repos r on r.id = p.repo_id""",
    "repos", "runs",
)
def runs_with_repo(spark, d):
    return dashboard.run_page(fx.runs(spark, d), fx.repositories(spark, d), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))


_LATEST = """with n as (select *, row_number() over (partition by repo_id order by started_at desc nulls last, id) as k from {runs})
  select r.id, r.github_url, r.branch, r.is_active, n.id as run_id, n.status as run_status from repos r left join n on n.repo_id = r.id and n.k = 1"""


@query(_LATEST.format(runs="runs"), "repos", "runs")
def latest_run_per_repo(spark, d):
    return catalog.repositories_with_latest(fx.repositories(spark, d), fx.runs(spark, d))


@query(_LATEST.format(runs="(select * from runs order by started_at desc nulls last, id limit 5)"), "repos", "runs")
def latest_run_in_top5(spark, d):
    return catalog.repositories_with_latest(fx.repositories(spark, d), fx.runs(spark, d), among=5)


@query("select repo_id, id from runs where repo_id not in (select id from repos where is_active)", "repos", "runs")
def orphan_runs(spark, d):
    return catalog.runs_without_repository(fx.runs(spark, d), catalog.active(fx.repositories(spark, d))).select("repo_id", "id")


@query("select id from repos where id not in (select repo_id from runs where status = 'success')", "repos", "runs")
def repos_without_success(spark, d):
    return catalog.repositories_without_success(fx.repositories(spark, d), fx.runs(spark, d)).select("id")


@query("select id, repo_id, github_url from runs join (select id as r, github_url from repos) on r = repo_id where status = 'queued'", "repos", "runs")
def queued_with_repo(spark, d):
    r = fx.repositories(spark, d).select(F.col("id").alias("repo_id"), "github_url")
    return fx.runs(spark, d).filter("status = 'queued'").join(r, "repo_id").select("id", "repo_id", "github_url")


@query("select id from runs where status in ('running', 'queued')", "runs")
def live_runs(spark, d):
    return fx.runs(spark, d).filter(F.col("status").isin("running", "queued")).select("id")


# Push events


@query(
    """with asked as (select id as event_id, regexp_replace(github_url, '\\.git$', '') as url from repos),
    f as (select event_id, 0 as rank, url as form from asked union all select event_id, 1, url || '.git' from asked),
    b as (select event_id, arg_min(id, rank * 1000000000 + id) as repo_id, arg_min(branch, rank * 1000000000 + id) as repo_branch from f join repos on github_url = form and is_active group by event_id)
    select asked.event_id, asked.url, coalesce(repo_id, -1) as repo_id, repo_branch from asked left join b using (event_id)""",
    "repos",
)
def match_event_repo(spark, d):
    repos = fx.repositories(spark, d)
    asked = repos.select(F.col("id").alias("event_id"), F.regexp_replace("github_url", r"\.git$", "").alias("url"))
    return webhook.match_repository(asked, repos).withColumn("repo_id", F.coalesce("repo_id", F.lit(-1)))


_OUTCOME = """with e as (
  select event_id, event_id % 11 <> 0 as signed, event_type <> 'error' as is_push, case when event_id % 4 = 0 then 'develop' else 'main' end as branch, event_id % 3 = 0 as nb,
    r.id as known, r.is_active as act, r.branch as rb from events left join repos r on r.id = user_id),
  o as (select event_id, case when not signed then 401 when not is_push then 200 when known is null or not act then 404 when branch <> rb then 200 when not nb then 200 else 202 end as code,
    case when not signed then 'Invalid webhook signature' when not is_push then 'Event ignored' when known is null or not act then 'Repository not registered'
      when branch <> rb then 'Branch ignored' when not nb then 'No notebook files modified' else 'Accepted' end as detail, known from e)"""


@query(_OUTCOME + " select event_id, code, detail from o", "repos")
def webhook_outcome(spark, d):
    secret = settings().webhook_secret
    return webhook.webhook_outcomes(fx.push_events(spark, d, secret), fx.repositories(spark, d), secret).select("event_id", "code", "detail")


@query(_OUTCOME + " select md5(event_id || '/' || md5(cast(event_id as varchar))) as id, known as repo_id, 'queued' as status, md5(cast(event_id as varchar)) as commit_sha from o where code = 202", "repos")
def created_runs(spark, d):
    secret = settings().webhook_secret
    return webhook.new_runs(webhook.webhook_outcomes(fx.push_events(spark, d, secret), fx.repositories(spark, d), secret))


@query("""select event_id, ['README.md', case event_id % 3 when 0 then 'notebooks/train.ipynb' when 1 then 'src/model.py' else 'notebooks/train.IPYNB' end][1] as first_file,
  cast(2 as bigint) as n_files, event_id % 3 = 0 as any_notebook from events""")
def changed_files(spark, d):
    p = webhook.parse_pushes(fx.push_events(spark, d, settings().webhook_secret), settings().webhook_secret)
    return p.select("event_id", F.get("files", F.lit(0)).alias("first_file"), F.size("files").cast("bigint").alias("n_files"), arrays.any_notebook(F.col("files")).alias("any_notebook"))


# Scalars


@query("""select id, nullif(regexp_extract(github_url, 'github\\.com[/:]([^/]+)/([^/.]+)', 1), '') as owner,
  nullif(regexp_extract(github_url, 'github\\.com[/:]([^/]+)/([^/.]+)', 2), '') as repo from repos""", "repos")  # fmt: skip
def owner_repo(spark, d):
    return fx.repositories(spark, d).select("id", strings.owner_of(F.col("github_url")).alias("owner"), strings.repo_of(F.col("github_url")).alias("repo"))


@query("select id, regexp_replace(regexp_replace(github_url, '^https://github.com/', ''), '\\.git$', '') as name, regexp_matches(github_url, '^https://github\\.com/[\\w.\\-]+/[\\w.\\-]+/?$') as well_formed from repos", "repos")
def repo_display_name(spark, d):
    return fx.repositories(spark, d).select("id", strings.display_name(F.col("github_url")).alias("name"), strings.is_repo_url(F.col("github_url")).alias("well_formed"))


@query("select id, replace('refs/heads/' || branch, 'refs/heads/', '') as branch from repos", "repos")
def branch_from_ref(spark, d):
    return fx.repositories(spark, d).select("id", strings.branch_of(F.concat(F.lit("refs/heads/"), "branch")).alias("branch"))


@query("select c_custkey as id, case when length(c_name) >= 4 then '****' || right(c_name, 4) else '****' end as masked, coalesce(nullif(substring(c_name, 1, c_custkey % 2), ''), 'none') as filled from customer")
def mask_token(spark, d):
    c = fx.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), strings.mask_token(F.col("c_name")).alias("masked"), strings.first_filled(F.substr("c_name", F.lit(1), (F.col("c_custkey") % 2).cast("int")), F.lit("none")).alias("filled"))


@query("select id, substring(id, 1, 8) as short_id, substring(commit_sha, 1, 7) as short_sha from runs", "runs")
def truncate_ids(spark, d):
    return fx.runs(spark, d).select("id", strings.short(F.col("id"), 8).alias("short_id"), strings.short(F.col("commit_sha")).alias("short_sha"))


@query("""select c_custkey as id, coalesce(nullif(trim(case when c_custkey % 3 = 0 then '  ' else ' dev ' end), ''), 'main') as branch,
  'http://model-server:8001/predict/' || c_name as endpoint, regexp_replace(c_name || '//', '/+$', '') as stripped from customer""")
def trim_default(spark, d):
    c = fx.table(spark, d, "customer")
    typed = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(" dev ")
    return c.select(F.col("c_custkey").alias("id"), strings.trim_or(typed, "main").alias("branch"), strings.endpoint_url(F.col("c_name"), settings().endpoint).alias("endpoint"), strings.strip_slashes(F.concat("c_name", F.lit("//"))).alias("stripped"))


def _pad(byte: int) -> str:
    return "".join(f"{b ^ byte:02x}" for b in b"test-secret".ljust(64, b"\0"))


@query(f"select doc_id, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(text)))) as signature from documents")
def hmac_signature(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", crypto.hmac_sha256(F.col("text"), "test-secret").alias("signature"))


@query("select doc_id, md5(text) as digest from documents")
def base64_decode(spark, d):
    wrapped = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{60})", "$1\r\n*")  # lines and a character that base64 hasn't
    return fx.table(spark, d, "documents").select("doc_id", F.md5(crypto.from_base64(wrapped)).alias("digest"))


@query(f"select seq, {_DURATION.format(s='ts', e="timestamp '2024-06-01 00:00:00'")} as duration from phase_events", "phase_events")
def duration_text(spark, d):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    return fx.phase_events(spark, d).select("seq", times.duration_text(F.col("ts"), F.lit(None).cast("timestamp_ntz"), now).alias("duration"))


@query("select seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as iso, strftime(ts, '%b %-d, %I:%M %p') as shown from phase_events", "phase_events")
def timestamps_text(spark, d):
    return fx.phase_events(spark, d).select("seq", times.iso(F.col("ts")).alias("iso"), times.date_text(F.col("ts")).alias("shown"))


@query("select id, case status when 'queued' then 'gray' when 'running' then 'blue' when 'success' then 'green' when 'failed' then 'red' else 'gray' end as style from runs", "runs")
def status_case(spark, d):
    return fx.runs(spark, d).select("id", display.status_style(F.col("status")).alias("style"))


@query("select seq, case when status = 'running' and phase = 'error' then 'error' when phase = 'purchase' then 'ok' else 'normal' end as level from phase_events", "phase_events")
def log_level(spark, d):
    e = fx.phase_events(spark, d)
    failed = F.when((F.col("status") == "running") & (F.col("phase") == "error"), "failed").otherwise(F.col("status"))
    return e.select("seq", display.log_level(F.when(F.col("phase") == "purchase", "complete").otherwise(F.col("phase")), failed).alias("level"))


@query("select id, accuracy >= 0.7 as deployed, case when accuracy < 0.7 then 'accuracy below threshold 0.70' end as reason from deployments", "deployments")
def deploy_reason(spark, d):
    a = F.col("accuracy")
    return fx.deployments(spark, d).select("id", display.passes_gate(a, True, 0.7).alias("deployed"), display.skip_reason(a, True, 0.7).alias("reason"))


@query("select pipeline_id, case when bool_and(status = 'success') then 'ok' else 'degraded' end as health, case when sum((phase = 'signup')::int) > 0 then 'ok' else 'no_models' end as models from phase_events group by pipeline_id", "phase_events")
def readiness(spark, d):
    e = fx.phase_events(spark, d)
    return e.groupBy("pipeline_id").agg(display.readiness(F.bool_and(F.col("status") == "success")).alias("health"), display.readiness(F.count_if(F.col("phase") == "signup") > 0, bad="no_models").alias("models"))


@query("select event_type as service, case when bool_and(coalesce(value >= 1, false)) then 'ok' else 'degraded' end as status from events group by event_type")
def health_rows(spark, d):
    return display.health_rows(fx.table(spark, d, "events").select(F.col("event_type").alias("service"), (F.col("value") >= 1).alias("ok")))


@query("select id, model_name, 'v' || version as version_text, round(accuracy * 100, 1) as accuracy_percent, is_active from deployments", "deployments")
def model_rows(spark, d):
    return dashboard.model_rows(fx.deployments(spark, d))


# Notebooks


@query("select notebook_id, count(*) as n, min(cell) as first_cell from cells where tag = 'mlops:training' group by notebook_id", "cells")
def cells_by_tag(spark, d):
    n = notebooks.nest_cells(fx.cells(spark, d)).withColumn("found", arrays.cells_with_tag(F.col("cells"), "mlops:training"))
    return n.filter(F.size("found") > 0).select("notebook_id", F.size("found").cast("bigint").alias("n"), F.get("found", F.lit(0))["cell"].alias("first_cell"))


@query(
    "with t as (select notebook_id, list_distinct(list(tag)) as tags from cells group by notebook_id) select notebook_id, "
    + "nullif(concat_ws(', ', " + ", ".join(f"case when not list_contains(tags, '{t}') then '{t}' end" for t in REQUIRED_TAGS) + "), '') as missing from t",
    "cells",
)
def missing_tags(spark, d):
    checked = notebooks.validate(notebooks.nest_cells(fx.cells(spark, d)))
    return checked.select("notebook_id", F.nullif(F.array_join("missing", ", "), F.lit("")).alias("missing"))


@query(
    """with s as (select notebook_id, arg_min('MODEL_NAME = "m-' || notebook_id || '"' || chr(10) || source, cell) filter (where tag = 'mlops:config') as src from cells group by notebook_id)
    select notebook_id, case when src is not null then coalesce(nullif(regexp_extract(src, 'MODEL_NAME\\s*=\\s*[''"]([^''"]+)[''"]', 1), ''), 'default-model') end as model_name,
    case when src is not null then coalesce(nullif(regexp_extract(src, 'VERSION\\s*=\\s*[''"]([^''"]+)[''"]', 1), ''), '1') end as version from s""",
    "cells",
)
def extract_config(spark, d):
    assigned = F.concat(F.lit('MODEL_NAME = "m-'), F.col("notebook_id").cast("string"), F.lit('"\n'), "source")
    n = notebooks.nest_cells(fx.cells(spark, d).withColumn("source", assigned))
    return notebooks.config_of(n).select("notebook_id", "model_name", "version")


@query(
    """with o as (select notebook_id, cell, substring(source, 1, 2000) as output, row_number() over (partition by notebook_id order by cell) as k from cells where cell_type = 'code' and source <> '')
    select notebook_id, count(*) as n_logs, sum(cell)::bigint as cells_sum, md5(string_agg(output, '|' order by cell)) as digest from o where k <= 20 group by notebook_id""",
    "cells",
)
def cell_outputs(spark, d):
    c = fx.cells(spark, d).withColumn("outputs", F.array(F.struct(F.col("source").alias("text"), F.create_map().cast("map<string,string>").alias("data"))))
    n = _nested_outputs(c)
    logs_ = notebooks.cell_logs(n).filter(F.size("logs") > 0)
    return logs_.select("notebook_id", F.size("logs").cast("bigint").alias("n_logs"), F.aggregate("logs", F.lit(0).cast("bigint"), lambda s, x: s + x["cell"]).alias("cells_sum"), F.md5(F.array_join(F.col("logs.output"), "|")).alias("digest"))


def _nested_outputs(cells: DataFrame) -> DataFrame:
    """Cells nested in order, each at the index of its turn."""
    one = F.struct(F.col("cell").alias("at"), "cell_type", F.transform("outputs", lambda o: F.struct(o["text"].alias("text"), F.lit(None).cast("map<string,string>").alias("data"))).alias("outputs"))
    grouped = cells.groupBy("notebook_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", one))).alias("by"), F.max("cell").alias("last"))
    return grouped.select("notebook_id", F.transform(F.sequence(F.lit(0).cast("bigint"), "last"), lambda i: F.try_element_at("by", i)).alias("cells"))


_BROKEN = "notebook_id % 13 in (5, 6)"
_LACKS = "with t as (select notebook_id, list_distinct(list(tag)) as tags from cells group by notebook_id), v as (select notebook_id, " + "nullif(concat_ws(', ', " + ", ".join(f"case when {_BROKEN} or not list_contains(tags, '{t}') then '{t}' end" for t in REQUIRED_TAGS) + "), '') as missing from t)"


@query(_LACKS + " select notebook_id, missing is null as is_valid, 'Missing required tags: ' || missing as error from v", "cells")
def notebook_validation(spark, d):
    """Notebook JSON, some of it broken or without cells."""
    return notebooks.check_notebooks(fx.raw_notebooks(spark, d)).select("notebook_id", "is_valid", "error")


@query(
    f"""with s as (select notebook_id, arg_min('MODEL_NAME = "m-' || notebook_id || '"' || chr(10) || source, cell) filter (where tag = 'mlops:config' and not ({_BROKEN})) as src from cells group by notebook_id)
    select notebook_id, md5(src) as source_md5, case when src is not null then coalesce(nullif(regexp_extract(src, 'MODEL_NAME\\s*=\\s*[''"]([^''"]+)[''"]', 1), ''), 'default-model') end as model_name,
    case when src is not null then coalesce(nullif(regexp_extract(src, 'VERSION\\s*=\\s*[''"]([^''"]+)[''"]', 1), ''), '1') end as version from s""",
    "cells",
)
def notebook_config(spark, d):
    """The configuration in notebook JSON, whose sources are strings or lists of lines."""
    n = notebooks.config_of(notebooks.check_notebooks(fx.raw_notebooks(spark, d)))
    first = F.get(arrays.cells_with_tag(F.col("cells"), "mlops:config"), F.lit(0))
    return n.select("notebook_id", F.md5(arrays.source_text(first["source"])).alias("source_md5"), "model_name", "version")


@query(
    f"""with i as (select *, row_number() over (partition by notebook_id order by cell) - 1 as place from cells where not ({_BROKEN})),
    o as (select notebook_id, place, substring(source, 1, 2000) as output, row_number() over (partition by notebook_id order by place) as k from i where cell_type = 'code' and source <> '')
    select notebook_id, count(*) as n_logs, sum(place)::bigint as cells_sum, md5(string_agg(output, '|' order by place)) as digest from o where k <= 20 group by notebook_id""",
    "cells",
)
def notebook_outputs(spark, d):
    """The logs of code cells in notebook JSON: stream text or plain-text data."""
    logs_ = notebooks.cell_logs(notebooks.check_notebooks(fx.raw_notebooks(spark, d))).filter(F.size("logs") > 0)
    return logs_.select("notebook_id", F.size("logs").cast("bigint").alias("n_logs"), F.aggregate("logs", F.lit(0).cast("bigint"), lambda s, x: s + x["cell"]).alias("cells_sum"), F.md5(F.array_join(F.col("logs.output"), "|")).alias("digest"))


@query(_LACKS + " select notebook_id, missing is null as is_valid from v", "cells")
def notebook_files(spark, d):
    """Notebooks read from files, sent as base64."""
    at = logs.state_dir(spark)
    fx.raw_notebooks(spark, d).select("notebook_id", F.base64(F.encode("raw", "UTF-8")).alias("content")).write.partitionBy("notebook_id").text(f"{at}/files")
    files = notebooks.read_notebooks(spark, f"{at}/files/*/*").withColumn("notebook_id", F.regexp_extract("path", "notebook_id=([0-9]+)", 1).cast("bigint"))
    return notebooks.check_notebooks(notebooks.decode_contents(files, "raw")).select("notebook_id", "is_valid")


# Runs


@query("select pipeline_id, count(*) as n, md5(string_agg(seq || phase || status, ',' order by seq)) as digest from phase_events group by pipeline_id", "phase_events")
def phase_list(spark, d):
    p = runs.phase_list(fx.phase_events(spark, d))
    text = F.transform("phases", lambda x: F.concat(x["seq"].cast("string"), x["phase"], x["status"]))
    return p.select("pipeline_id", F.size("phases").cast("bigint").alias("n"), F.md5(F.array_join(text, ",")).alias("digest"))


_TYPES = ["signup", "view", "click", "purchase", "error"]
_TIMELINE = """with t as (select * from (values """ + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_TYPES)) + """) x(position, phase)),
  k as (select pipeline_id, phase, {pick}(status, seq) as status from phase_events group by pipeline_id, phase), p as (select distinct pipeline_id from phase_events)
  select p.pipeline_id, t.position, t.phase, coalesce(k.status, 'pending') as status from p cross join t left join k on k.pipeline_id = p.pipeline_id and k.phase = t.phase"""


@query(_TIMELINE.format(pick="arg_max"), "phase_events")
def phase_timeline(spark, d):
    return runs.timeline(fx.phase_events(spark, d), _TYPES)


@query(_TIMELINE.format(pick="arg_min"), "phase_events")
def phase_timeline_first(spark, d):
    return runs.timeline(fx.phase_events(spark, d), _TYPES, mode="first")


@query("""select pipeline_id, arg_max(status, seq) as status, arg_max(case when phase = 'error' then ts end, case when phase = 'error' then seq end) as failed_at,
  arg_max(phase, case when phase <> 'view' then seq end) as phase from phase_events group by pipeline_id""", "phase_events")  # fmt: skip
def fold_updates(spark, d):
    e = fx.phase_events(spark, d)
    updates = e.select("pipeline_id", "seq", "status", F.when(F.col("phase") == "error", F.col("ts")).alias("failed_at"), F.when(F.col("phase") != "view", F.col("phase")).alias("phase"))
    return runs.fold_updates(updates, "pipeline_id", "seq", ["status", "failed_at", "phase"])


@query("""select pipeline_id, case when bool_or(phase = 'error') then 'failed' when bool_or(phase = 'purchase') then 'success' else 'running' end as status,
  min(ts) as started_at, max(case when phase in ('error', 'purchase') then ts end) as finished_at, count(*) as n_events from phase_events group by pipeline_id""", "phase_events")  # fmt: skip
def run_status(spark, d):
    e = fx.phase_events(spark, d)
    return runs.run_status(e.withColumn("phase", F.when(F.col("phase") == "purchase", "complete").otherwise(F.col("phase"))))


@query("select pipeline_id, phase, cast(date_diff('millisecond', min(ts), max(ts)) as double) / 1000 as seconds from phase_events group by pipeline_id, phase", "phase_events")
def phase_durations(spark, d):
    return runs.phase_durations(fx.phase_events(spark, d))


@query("with n as (select pipeline_id, seq, row_number() over (partition by pipeline_id order by seq desc) as k from phase_events) select pipeline_id, seq from n where k <= 1000", "phase_events")
def log_tail_1000(spark, d):
    return runs.tail(fx.phase_events(spark, d)).select("pipeline_id", "seq")


@query("select pipeline_id, seq from phase_events where pipeline_id in (select pipeline_id from phase_events group by pipeline_id having max(ts) >= (select max(ts) from phase_events) - interval 24 hours)", "phase_events")
def log_replay_ttl(spark, d):
    e = fx.phase_events(spark, d)
    now = e.agg(F.max("ts").alias("now")).scalar()
    return runs.replay(e, now).select("pipeline_id", "seq")


@query("""with x as (select pipeline_id, min(seq) as stop from phase_events where phase = 'error' group by pipeline_id)
  select e.pipeline_id, e.seq from phase_events e left join x using (pipeline_id) where stop is null or seq <= stop""", "phase_events")  # fmt: skip
def log_until_terminal(spark, d):
    return runs.until_terminal(fx.phase_events(spark, d)).select("pipeline_id", "seq")


# Metrics


_NUMBER = "kind in ('DOUBLE', 'UBIGINT', 'BIGINT', 'HUGEINT')"


@query(f"select distinct key from metric where {_NUMBER}", "run_metrics", "metric")
def metric_keys(spark, d):
    return metrics.metric_keys(metrics.long_metrics(fx.run_metrics(spark, d), "id", "metrics"))


@query(f"select id, coalesce(max(case when key = 'accuracy' and {_NUMBER} then cast(text as double) end), 0.0) as accuracy from run_metrics left join metric on run = id group by id", "run_metrics", "metric")
def metric_value_default(spark, d):
    return fx.run_metrics(spark, d).select("id", arrays.number_or(F.col("metrics"), "accuracy", 0.0).alias("accuracy"))


@query(f"""select run, max(case when key = 'accuracy' then cast(text as double) end) as accuracy, max(case when key = 'loss' then cast(text as double) end) as loss, max(case when key = 'f1' then cast(text as double) end) as f1
  from metric where {_NUMBER} group by run""", "run_metrics", "metric")  # fmt: skip
def metric_pivot(spark, d):
    return metrics.pivot_metrics(metrics.long_metrics(fx.run_metrics(spark, d), "id", "metrics"), ["accuracy", "loss", "f1"])


@query(f"""select run, key, case when {_NUMBER} then printf('%.4f', cast(text as double) + case when cast(text as double) * 32 = floor(cast(text as double) * 32) then 1e-9 else 0 end)
  when kind = 'NULL' then null else text end as shown from metric""", "run_metrics", "metric")  # fmt: skip
def metric_text(spark, d):
    return metrics.all_metrics(fx.run_metrics(spark, d), "id", "metrics").select("run", "key", display.value_text(F.col("value")).alias("shown"))


@query("select id from run_metrics where status = 'success' and id in (select run from metric where key = 'deployed' and kind = 'BOOLEAN' and text = 'true')", "run_metrics", "metric")
def deployed_runs(spark, d):
    return runs.deployed(fx.run_metrics(spark, d)).select("id")


@query("""select id, '{"accuracy":' || accuracy || ',"deployed":' || (accuracy >= 0.7) || ',"skip_reason":' || case when accuracy < 0.7 then '"accuracy below threshold 0.70"' else 'null' end || '}' as metrics from deployments""", "deployments")
def metrics_json(spark, d):
    return runs.with_deployment(fx.deployments(spark, d), "accuracy", True, 0.7).select("id", "metrics")


@query("select id, cast(2 as bigint) as n, accuracy, 1.0 as deployed from deployments", "deployments")
def metrics_with_entry(spark, d):
    held = F.create_map(F.lit("accuracy"), F.col("accuracy"), F.lit("deployed"), F.lit(0.0))
    out = fx.deployments(spark, d).select("id", arrays.with_entry(held, "deployed", F.lit(1.0)).alias("m"))
    return out.select("id", F.size("m").cast("bigint").alias("n"), F.element_at("m", "accuracy").alias("accuracy"), F.element_at("m", "deployed").cast("decimal(2,1)").alias("deployed"))


@query("""select substring(r.id, 1, 6) as label, 'k' as key, cast(json_extract_string(props, '$.k') as double) as value
  from (select * from runs order by started_at desc nulls last, id limit 1000) r join events e on cast(e.event_id as varchar) = r.id where r.repo_id % 2 = 1 and r.repo_id = 1 and json_extract_string(props, '$.k') is not null""", "runs")  # fmt: skip
def history_metrics(spark, d):
    long = metrics.long_metrics(fx.table(spark, d, "events"), "event_id", "props").withColumn("run", F.col("run").cast("string"))
    return dashboard.metric_series(fx.runs(spark, d), long, repo=1, among=1000)


# Registry


@query("""with new as (select model_name, max(id) + 1000000 as id from deployments where id % 3 = 0 group by model_name)
  select id, model_name, version, accuracy, is_active and model_name not in (select model_name from new) as is_active from deployments
  union all select id, model_name, 'next' as version, 0.9 as accuracy, true as is_active from new""", "deployments")  # fmt: skip
def activate_version(spark, d):
    dep = fx.deployments(spark, d)
    new = dep.filter("id % 3 = 0").groupBy("model_name").agg((F.max("id") + 1_000_000).alias("id")).select("id", "model_name", F.lit("next").alias("version"), F.lit(0.9).alias("accuracy"), F.lit(True).alias("is_active"))
    return registry.activate(dep, new)


@query("""with t as (select model_name, version, min(id) as target from deployments where version = '7' group by model_name, version)
  select d.id, d.model_name, d.version, d.accuracy, case when t.target is not null then d.id = t.target else d.is_active end as is_active from deployments d left join t on t.model_name = d.model_name""", "deployments")  # fmt: skip
def rollback_version(spark, d):
    dep = fx.deployments(spark, d)
    return registry.rollback(dep, dep.select("model_name", F.lit("7").alias("version")).distinct())


@query("select id, model_name, version, accuracy, is_active and model_name <> 'Brand#11' as is_active from deployments", "deployments")
def unregister_model(spark, d):
    dep = fx.deployments(spark, d)
    return registry.unregister(dep, spark.createDataFrame([("Brand#11",)], "model_name string"))


@query("select id, lag(version) over (partition by model_name order by id) as previous from deployments", "deployments")
def previous_version(spark, d):
    return registry.previous_version(fx.deployments(spark, d)).select("id", "previous")


@query("select event_id, p.version from events left join (select distinct 'Brand#' || (10 + (user_id % 60)) as model, user_id from events) m using (user_id) left join (select model_name, version from deployments where is_active) p on p.model_name = m.model", "deployments")
def resolve_model(spark, d):
    asked = fx.table(spark, d, "events").select("event_id", F.concat(F.lit("Brand#"), (10 + F.col("user_id") % 60).cast("string")).alias("model_name"))
    return registry.resolve(asked, fx.deployments(spark, d)).select("event_id", "version")


@query("select event_type as model_name, count(*) as requests from events where value >= 20 group by event_type")
def request_counts(spark, d):
    e = fx.table(spark, d, "events")
    return registry.request_counts(e.select(F.col("event_type").alias("model_name"), (F.col("value") >= 20).alias("ok")))


@query("""with new as (select id + 1000000 as id, model_name from deployments where id % 3 = 0), top as (select model_name, max(id) as id from new group by model_name)
  select id, model_name, is_active and model_name not in (select model_name from new) as is_active from deployments
  union all select id, model_name, id in (select id from top) as is_active from new""", "deployments")  # fmt: skip
def activate_many(spark, d):
    """Several new deployments of one model: the newest is active, and old rows come once."""
    dep = fx.deployments(spark, d).select("id", "model_name", "is_active")
    return registry.activate(dep, dep.filter("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000))


@query("select p_partkey as id, md5(cast(p_partkey // 2 as varchar)) as run_id from part where p_partkey % 2 = 0 and p_partkey // 2 in (select p_partkey from part) union all select p_partkey, null from part where not (p_partkey % 2 = 0 and p_partkey // 2 in (select p_partkey from part))")
def deployment_runs(spark, d):
    dep = fx.deployments(spark, d).withColumn("pipeline_id", F.col("id").cast("string"))
    return registry.with_run(dep, fx.model_runs(spark, d)).select("id", "run_id")


@query("""with s as (select event_id as seq, case event_type when 'signup' then 'load' when 'error' then 'unload' else 'predict' end as action, 'm-' || (user_id % 40) as model_name,
    cast(event_id % 9 as varchar) as version, value >= 20 as ok, ts from events),
  l as (select model_name, arg_max(action, seq) as action, arg_max(version, seq) as version, arg_max(ts, seq) as ts, max(seq) as since from s where action <> 'predict' group by model_name)
  select l.model_name, l.version, strftime(l.ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as loaded_at, (select count(*) from s where s.model_name = l.model_name and action = 'predict' and ok and seq > since) as request_count
  from l where action = 'load'""")  # fmt: skip
def loaded_models(spark, d):
    return serving.loaded_models(fx.serving_events(spark, d))


@query("select id, model_name, accuracy >= 0.7 as deployed from deployments", "deployments")
def deploy_gate(spark, d):
    s = settings()
    return fx.deployments(spark, d).select("id", "model_name", display.passes_gate(F.col("accuracy"), s.auto_deploy, s.deploy_threshold).alias("deployed"))


# Training and evaluation

_SPLIT = "with n as (select *, row_number() over (partition by label order by md5(cast(vec_id as varchar)), vec_id) as k, count(*) over (partition by label) as c from embeddings)"


@query(_SPLIT + " select vec_id, label, k <= ceil(c * 0.2) as is_test from n")
def stratified_split(spark, d):
    return evaluation.stratified_split(fx.table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label")


@query("select i::int as feature, round(avg(embedding[i + 1]::double), 9) as mean, round(stddev_pop(embedding[i + 1]::double), 9) as std from embeddings, range(64) t(i) group by i")
def scaler_stats(spark, d):
    s = evaluation.scaler_stats(fx.table(spark, d, "embeddings"), "embedding", 64)
    return s.select("feature", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("""with s as (select avg(embedding[1]::double) as m, stddev_pop(embedding[1]::double) as s, avg(embedding[64]::double) as m2, stddev_pop(embedding[64]::double) as s2 from embeddings)
  select vec_id, round((embedding[1]::double - m) / s, 6) as first, round((embedding[64]::double - m2) / s2, 6) as last from embeddings, s""")
def scaled_features(spark, d):
    e = fx.table(spark, d, "embeddings")
    out = evaluation.scaled(e, "embedding", evaluation.scaler_stats(e, "embedding", 64))
    return out.select("vec_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(F.get("embedding", F.lit(63)), 6).alias("last"))


@query("select count(*) as rows, count(distinct label) as classes, cast(max(len(embedding)) as bigint) as width from embeddings")
def dataset_shape(spark, d):
    return fx.table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("label").alias("classes"), F.max(F.size("embedding")).cast("bigint").alias("width"))


@query("select avg(case when quality = toxic then 1.0 else 0.0 end)::double as accuracy from labels")
def accuracy(spark, d):
    return evaluation.accuracy(fx.table(spark, d, "labels"), "quality", "toxic")


@query(
    """with c as (select v as label, sum((quality = v)::int)::bigint as support, sum((toxic = v)::int)::bigint as said, sum((quality = v and toxic = v)::int)::bigint as hits from labels, (values (0), (1)) t(v) group by v),
    s as (select label, support, hits, case when said = 0 then 0.0 else hits::double / said end as p, case when support = 0 then 0.0 else hits::double / support end as r from c),
    f as (select *, case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end as f1 from s)
    select cast(label as varchar) as label, round(p, 9) as precision, round(r, 9) as recall, round(f1, 9) as f1, support from f
    union all select 'accuracy', round(sum(hits)::double / sum(support), 9), round(sum(hits)::double / sum(support), 9), round(sum(hits)::double / sum(support), 9), sum(support)::bigint from f
    union all select 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9), sum(support)::bigint from f
    union all select 'weighted avg', round(sum(p * support)::double / sum(support), 9), round(sum(r * support)::double / sum(support), 9), round(sum(f1 * support)::double / sum(support), 9), sum(support)::bigint from f"""
)
def classification_report(spark, d):
    r = evaluation.classification_report(fx.table(spark, d, "labels"), "quality", "toxic")
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query()
def train_forest(spark, d):
    split = evaluation.stratified_split(fx.table(spark, d, "embeddings"), "vec_id", "label")
    model = evaluation.train_forest(split.filter("not is_test"), "embedding", "label", trees=20)
    scored = evaluation.predict(model, split.filter("is_test"), "embedding")
    return evaluation.classification_report(scored.withColumn("prediction", F.col("prediction").cast("int")), "label", "prediction")


@query()
def batch_predict(spark, d):
    rows = fx.table(spark, d, "embeddings")
    model = evaluation.train_forest(rows, "embedding", "label", trees=10)
    return evaluation.predict(model, rows, "embedding").select("vec_id", F.col("prediction").cast("int").alias("prediction"))


# The platform's reads and writes


def _api(spark, d) -> Api:
    return Api(fx.repositories(spark, d), fx.runs(spark, d), fx.phase_events(spark, d), fx.deployments(spark, d))


@query("""with n as (select id, status, row_number() over (order by started_at desc nulls last, id) - 1 as k, count(*) over () as total from runs)
  select cast(k - 40 as integer) as pos, id, status, total, 3 as page, 20 as size, (total + 19) // 20 as pages from n where k >= 40 and k < 60""", "runs")  # fmt: skip
def api_page(spark, d):
    e = _api(spark, d).page(3, 20)
    return e.select(F.posexplode("items").alias("pos", "item"), "total", "page", "size", "pages").select("pos", "item.id", "item.status", "total", "page", "size", "pages")


@query("select id from (select id, row_number() over (order by started_at desc nulls last, id) as k from runs) where k > 20 and k <= 40", "runs")
def page_keyset(spark, d):
    last = catalog.page_of(fx.runs(spark, d), 1, 20).collect()[-1]
    return catalog.page_after(fx.runs(spark, d), (last["started_at"], last["id"]), 20).select("id")


@query("""select r.id, r.status, r.commit_sha, coalesce(n, -1) as n_phases, digest from (select * from runs where id = '7') r left join
  (select cast(pipeline_id as varchar) as id, count(*) as n, md5(string_agg(seq || phase || status, ',' order by seq)) as digest from phase_events group by pipeline_id) p on p.id = r.id""", "runs", "phase_events")  # fmt: skip
def api_run(spark, d):
    text = F.array_join(F.transform("phases", lambda x: F.concat(x["seq"].cast("string"), x["phase"], x["status"])), ",")
    return _api(spark, d).run("7").select("id", "status", "commit_sha", F.coalesce(F.size("phases"), F.lit(-1)).cast("bigint").alias("n_phases"), F.md5(text).alias("digest"))


@query("select seq, phase, status from phase_events where pipeline_id = 7 and seq <= coalesce((select min(seq) from phase_events where pipeline_id = 7 and phase = 'error'), 1000000000)", "phase_events")
def api_logs(spark, d):
    return _api(spark, d).logs("7").select("seq", "phase", "status")


@query("select id, model_name, version from deployments where is_active", "deployments")
def api_models(spark, d):
    return _api(spark, d).models().select("id", "model_name", "version")


@query("""with t as (select min(id) as target from deployments where model_name = 'Brand#11' and version = (select min(version) from deployments where model_name = 'Brand#11'))
  select id, model_name, version, case when model_name = 'Brand#11' then id = target else is_active end as is_active from deployments, t""", "deployments")  # fmt: skip
def api_rollback(spark, d):
    api = _api(spark, d)
    version = api.deployments.filter("model_name = 'Brand#11'").agg(F.min("version")).first()[0]
    return api.rollback("Brand#11", f'{{"version": "{version}"}}').select("id", "model_name", "version", "is_active")


@query("select id, github_url from repos where is_active order by id limit 1", "repos")
def first_repository(spark, d):
    return catalog.first_row(_api(spark, d).list_repositories()).select("id", "github_url")


@query("select * from (values ('auto_deploy', 'True'), ('default_branch', 'main'), ('default_token', ''), ('deploy_threshold', '0.7'), ('endpoint', 'http://model-server:8001'), ('log_buffer', '1000'), ('log_ttl_hours', '24'), ('max_page_size', '100'), ('notebook_path', 'notebooks/train.ipynb'), ('page_size', '20'), ('webhook_secret', 'test-secret')) t(name, value)")
def settings_scan(spark, d):
    return spark.createDataFrame([(k, str(v)) for k, v in vars(Settings()).items()], "name string, value string")


@query("""select event_id, [null, 'branch: not a valid string', 'github_url: field required', 'github_url: field required', 'body is not an object', 'body is not JSON', 'github_url: not a valid string', null][event_id % 8 + 1] as error from events""")
def body_validation(spark, d):
    return bodies.validated(fx.request_bodies(spark, d), "body", "repository").select("event_id", "error")


@query("select event_id from events where event_id % 8 in (0, 7)")
def accepted_bodies(spark, d):
    return bodies.accepted(bodies.validated(fx.request_bodies(spark, d), "body", "repository")).select("event_id")


@query("select case when event_id % 7 = 0 then null else cast(json_extract_string(props, '$.k') as bigint) end as k, count(*) as n from events group by 1")
def tolerant_log(spark, d):
    """Entries of a JSON log by value; broken lines are kept apart and counted under null."""
    lines = fx.table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("value"))
    good, bad = tables.tolerant(lines, "k bigint")
    return good.groupBy("k").agg(F.count(F.lit(1)).alias("n")).unionByName(bad.agg(F.lit(None).cast("bigint").alias("k"), F.count(F.lit(1)).alias("n")).filter("n > 0"))


@query("select id, github_url from repos union all select (select max(id) from repos) + 1, 'https://github.com/new/repo'", "repos")
def add_repository(spark, d):
    new = spark.createDataFrame([("https://github.com/new/repo",)], "github_url string")
    return tables.register(fx.repositories(spark, d).select("id", "github_url"), new)


@query("select id, github_url from repos where id % 5 <> 0", "repos")
def delete_repositories(spark, d):
    """A versioned table after a delete, read back."""
    at, repos = logs.state_dir(spark), fx.repositories(spark, d).select("id", "github_url")
    tables.write_version(repos, at)
    tables.write_version(tables.delete_keys(tables.read_version(spark, at), repos.filter("id % 5 = 0"), "id"), at)
    return tables.read_version(spark, at)


@query("select id, case when id % 4 = 0 then 'loaded again' else version end as version from deployments union all select -1, 'new'", "deployments")
def upsert_models(spark, d):
    held = fx.deployments(spark, d).select("id", "version")
    changes = held.filter("id % 4 = 0").select("id", F.lit("loaded again").alias("version")).unionByName(spark.createDataFrame([(-1, "new")], held.schema))
    return tables.upsert(held, changes, "id")


@query("select seq, strftime(ts, '%-I:%M:%S %p') as clock from phase_events", "phase_events")
def clock_text(spark, d):
    return fx.phase_events(spark, d).select("seq", times.clock_text(F.col("ts")).alias("clock"))


# Streams, over the same files as the batch queries

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _phase_stream(spark, d, at: str) -> DataFrame:
    """The phase events as a stream, from files that arrive in a folder."""
    fx.table(spark, d, "events").write.parquet(f"{at}/in")
    return fx.phase_events_of(logs.stream_files(spark, f"{at}/in", _EVENTS))


@query(SQL["webhook_outcome"])
def stream_ingest(spark, d):
    """The gates over a stream of signed JSON bodies."""
    secret, at = settings().webhook_secret, logs.state_dir(spark)
    fx.push_events(spark, d, secret).write.json(f"{at}/in")
    logs.drain(logs.ingest(logs.stream_bodies(spark, f"{at}/in"), fx.repositories(spark, d), secret).select("event_id", "code", "detail"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


@query("select pipeline_id, seq, phase, status from phase_events where pipeline_id = 7", "phase_events")
def stream_tail(spark, d):
    at = logs.state_dir(spark)
    logs.drain(logs.live_tail(_phase_stream(spark, d, at), 7).select("pipeline_id", "seq", "phase", "status"), f"{at}/out", f"{at}/state")
    return spark.read.schema("pipeline_id bigint, seq bigint, phase string, status string").parquet(f"{at}/out")


@query("select pipeline_id, arg_max(phase, seq) as phase, arg_max(status, seq) as status, count(*) as n_events from phase_events group by pipeline_id", "phase_events")
def stream_state(spark, d):
    at = logs.state_dir(spark)
    logs.drain(logs.run_state(_phase_stream(spark, d, at)), f"{at}/out", f"{at}/state", mode="update")
    return logs.newest_batch(spark, f"{at}/out", "pipeline_id")


@query("""with r as (select min(pipeline_id) as run from phase_events where phase = 'error')
  select seq, phase, status from phase_events, r where pipeline_id = run and seq <= (select min(seq) from phase_events, r where pipeline_id = run and phase = 'error')""", "phase_events")  # fmt: skip
def stream_follow(spark, d):
    """A live tail that ends at the run's first terminal entry."""
    at, run = logs.state_dir(spark), fx.phase_events(spark, d).filter("phase = 'error'").agg(F.min("pipeline_id")).first()[0]
    logs.follow(_phase_stream(spark, d, at), run, lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/state", wait=120)
    return runs.until_terminal(spark.read.parquet(f"{at}/out")).select("seq", "phase", "status")
