import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.llm import warc

T0 = datetime(2024, 1, 1)
SCHEMA = "record_id bigint, url string, at timestamp, is_full boolean, headers map<string,string>"


def resolved(spark, rows):
    return {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_canonical_urls(spark):
    cases = {
        "HTTPS://www.Example.com:443/a/?utm_source=x&b=2&a=1#top": "example.com/a?a=1&b=2", "http://m.example.com": "example.com", "http://e.com/A/": "e.com/A", "http://e.com/?ref=1": "e.com",
        "": None, "  ": None, None: None, "e.com/p?q": "e.com/p?q",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc.canonical_url(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in df.collect()} == cases


def test_validators_and_headers(spark):
    u, h = "http://e.com/a", timedelta(hours=1)
    full = {"etag": '"1"', "last-modified": "x", "content-type": "text/html", "vary": "a"}
    got = resolved(spark, [
        (1, u, T0, True, full), (2, u + "/", T0 + h, False, {"etag": 'W/"1"', "vary": "b", "content-type": "no"}), (3, u, T0 + h, False, {"etag": '"2"'}),
        (4, u, T0 + h, False, {"last-modified": "x"}), (5, u, T0 + h, False, {"last-modified": "y"}), (6, u, T0 + h, False, None), (7, u, T0 - h, False, {}),
        (8, None, T0, False, {}), (9, u, None, False, {}), (10, "http://other/", T0, False, {}), (11, u, None, True, full), (12, u, T0 + 40 * h, False, {}), (0, u, T0, False, {}),
    ])
    assert {i: r["validation"] for i, r in got.items()} == {1: "full", 2: "etag", 3: "mismatch", 4: "last-modified", 5: "mismatch", 6: "unvalidated", 7: "unmatched", 8: "unmatched", 9: "unmatched", 10: "unmatched", 11: "unmatched", 12: "unvalidated", 0: "unmatched"}
    assert got[2]["merged_headers"] == full | {"etag": 'W/"1"', "vary": "b"} and got[2]["match_id"] == 1 and got[3]["match_id"] is None


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(1)
    urls = ["http://hot/"] * 6 + ["http://a/", "http://b/?x=1", None]
    rows = [(n, rng.choice(urls), None if rng.random() < 0.05 else T0 + timedelta(minutes=rng.randrange(4000)), rng.random() < 0.3, {}) for n in range(400)]
    got = resolved(spark, rows)
    for i, u, at, full, _ in rows:
        before = [(a, n) for n, v, a, f, _ in rows if f and v == u and v and a and at and (a, n) < (at, i)]
        want = max(before)[1] if before and not (full and u and at) else None
        assert got[i]["match_id"] == want, i


def test_dense_bursts_and_repeated_rows(spark):
    """One URL with all records at one date, and repeated rows: buckets of ten records."""
    rows = [(n, "http://hot/", T0, n % 40 == 7, {}) for n in range(300)] + [(n, "http://hot/", T0 + timedelta(hours=1), False, {}) for n in (500, 500, 500)] + [(7, "http://hot/", T0, True, {})]
    out = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA), bucket_rows=10).collect()
    assert len(out) == len(rows)
    for r in out:
        want = [n for n in range(7, 300, 40) if n < r["record_id"]]
        assert r["match_id"] == (None if r["is_full"] or not want else max(want)), r


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://a/", T0, True, {})], SCHEMA).withColumn("validation", F.lit("old"))
    assert warc.resolve_revisits(df).first()["validation"] == "full" and warc.resolve_revisits(df.limit(0)).count() == 0
