import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.crypto import from_base64, hmac_sha256
from millrace.operators import webhook

SECRET = "test-secret"
REPOS = [(1, "https://github.com/u/r", "main", True), (2, "https://github.com/u/g.git", "main", True), (3, "https://github.com/u/off", "main", False), (4, "https://github.com/u/r", "main", True)]


def push(url="https://github.com/u/r", ref="refs/heads/main", modified=("notebooks/a.ipynb",)):
    return json.dumps({"ref": ref, "after": "abc", "repository": {"html_url": url}, "commits": [{"id": "c", "added": [], "modified": list(modified), "removed": ["x.ipynb"]}]})


def sign(body):
    return "sha256=" + hmac.new(SECRET.encode(), body.encode(), hashlib.sha256).hexdigest()


CASES = {
    "valid": (push(), "push", True, 202, 1),
    "suffix": (push("https://github.com/u/g"), "push", True, 202, 2),
    "bad signature": (push(), "push", False, 401, 1),
    "no signature": (push(), "push", None, 401, 1),
    "ping": (push(), "ping", True, 200, 1),
    "unknown": (push("https://github.com/u/x"), "push", True, 404, None),
    "inactive": (push("https://github.com/u/off"), "push", True, 404, None),
    "branch": (push(ref="refs/heads/dev"), "push", True, 200, 1),
    "no notebook": (push(modified=["a.py", "b.IPYNB"]), "push", True, 200, 1),
    "malformed": ("{", "push", True, 404, None),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = []
    for n, (body, kind, good, _, _) in enumerate(CASES.values()):
        rows.append((n, kind, body, None if good is None else sign(body) if good else "sha256=00"))
    events = spark.createDataFrame(rows, "event_id bigint, event_type string, body string, signature string")
    repos = spark.createDataFrame(REPOS, "id bigint, github_url string, branch string, is_active boolean")
    return webhook.webhook_outcomes(events, repos, SECRET).collect()


def test_outcomes(judged):
    got = {r["event_id"]: (r["code"], r["repo_id"]) for r in judged}
    for n, (name, case) in enumerate(CASES.items()):
        assert got[n] == case[3:], name


def test_new_runs_replay_alike(spark, judged):
    schema = "event_id bigint, repo_id bigint, commit_sha string, code int"
    df = spark.createDataFrame([(r["event_id"], r["repo_id"], r["commit_sha"], r["code"]) for r in judged], schema)
    a, b = webhook.new_runs(df).collect(), webhook.new_runs(df).collect()
    assert sorted(a) == sorted(b) and len(a) == 2 and {r["status"] for r in a} == {"queued"}


@pytest.mark.parametrize("secret", ["k", "x" * 64, "long" * 40])
def test_hmac(spark, secret):
    texts = ["", "a", "ünï" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hmac_sha256(F.col("t"), secret).alias("h"))
    for r in df.collect():
        assert r["h"] == hmac.new(secret.encode(), r["t"].encode(), hashlib.sha256).hexdigest()


def test_base64_skips_line_breaks(spark):
    df = spark.createDataFrame([("aGVs\nbG8=\n",)], "t string")
    assert df.select(from_base64(F.col("t"))).first()[0] == "hello"
