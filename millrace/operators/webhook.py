"""Push events: signature, gates in order, match to a repository, creation of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import any_notebook, changed_files
from ..functions.crypto import signature_is_valid
from ..functions.strings import branch_of
from ..schemas import PUSH_EVENT


def parse_pushes(events: DataFrame, secret: str) -> DataFrame:
    """``events`` (event_type, body, signature) with url, branch, sha, files and ``signed``; malformed bodies give nulls."""
    push = F.from_json("body", PUSH_EVENT)
    return (
        events.withColumn("_push", push)
        .withColumns({
            "url": F.col("_push.repository.html_url"),
            "branch": branch_of(F.coalesce(F.col("_push.ref"), F.lit(""))),
            "commit_sha": F.coalesce(F.col("_push.after"), F.lit("")),
            "files": changed_files(F.col("_push.commits")),
            "signed": signature_is_valid(F.col("body"), F.col("signature"), secret),
        })
        .drop("_push")
    )


def match_repository(pushes: DataFrame, repos: DataFrame, key: str = "event_id") -> DataFrame:
    """``pushes`` with repo_id and repo_branch of the active repository of their URL, else of URL + ``.git``; nulls if none.

    Two equalities instead of one disjunction: each repository is keyed once by
    its URL, the push by its two forms, in order.
    """
    forms = F.array(F.struct(F.lit(0).alias("rank"), F.col("url").alias("form")), F.struct(F.lit(1).alias("rank"), F.concat("url", F.lit(".git")).alias("form")))
    asked = pushes.select(key, F.explode(forms).alias("f")).select(key, "f.rank", "f.form").filter("form is not null")
    known = repos.filter("is_active").groupBy("github_url").agg(F.min(F.struct("id", "branch")).alias("repo"))
    best = asked.join(known, asked["form"] == known["github_url"]).groupBy(key).agg(F.min(F.struct("rank", "repo.id", "repo.branch")).alias("best"))
    return pushes.join(best, key, "left").withColumns({"repo_id": F.col("best.id"), "repo_branch": F.col("best.branch")}).drop("best")


def outcomes(matched: DataFrame) -> DataFrame:
    """``code`` and ``detail`` by the gates in order: signature, type, repository, branch, notebook."""
    gates = [
        (~F.col("signed"), 401, "Invalid webhook signature"),
        (F.coalesce(F.col("event_type") != "push", F.lit(True)), 200, "Event ignored"),
        (F.col("repo_id").isNull(), 404, "Repository not registered"),
        (F.col("branch") != F.col("repo_branch"), 200, "Branch ignored"),
        (~F.coalesce(any_notebook(F.col("files")), F.lit(False)), 200, "No notebook files modified"),
    ]
    code, detail = F.lit(202), F.lit("Accepted")
    for fails, number, text in reversed(gates):
        code, detail = F.when(fails, number).otherwise(code), F.when(fails, text).otherwise(detail)
    return matched.withColumns({"code": code, "detail": detail})


def webhook_outcomes(events: DataFrame, repos: DataFrame, secret: str) -> DataFrame:
    return outcomes(match_repository(parse_pushes(events, secret), repos))


def new_runs(judged: DataFrame) -> DataFrame:
    """Queued runs of accepted pushes; ids follow from the events, so a replay makes no others."""
    return judged.filter("code = 202").select(F.md5(F.concat_ws("/", F.col("event_id").cast("string"), "commit_sha")).alias("id"), "repo_id", F.lit("queued").alias("status"), "commit_sha")
