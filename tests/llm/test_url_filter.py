import re

from millrace.llm import url_filter

BLOCK, ALLOW, HOSTS = [("net", "/"), ("example.com", "/de/"), ("a.b.c", "")], [("example.net", "/en/"), ("org", "/fr/")], ["bad.org", "worse.example.net"]
URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/x", "http://sub.example.net/en/", "http://example.net/en", "http://notexample.com/de/", "http://example.com/de/?q=/x", "http://example.com?/de/",
    "http://x.org/fr/a", "http://x.org/fr", "http://bad.org/a", "http://very.bad.org#x", "http://badbad.org/", "x://y://z", "http://a.b.c", "http://z.a.b.c/p", "http://net/", "http://net", "http://É.net/\n", "http://worse.example.net/en/1",
    "http://" + "a." * 3000 + "net/", "http://x.net/" + "p" * 5000,
]


def brute(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[2]) if m else ""
    path = m[3] if m else ""
    fit = [(h + p, kind) for kind, rules in (("block", BLOCK), ("allow", ALLOW)) for h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    if fit:
        return (host, path, *max(fit, key=lambda x: len(x[0])))
    return (host, path, None, "block" if any(("." + host).endswith("." + h) for h in HOSTS) else "allow")


def test_verdicts(spark, monkeypatch):
    rows = [(n, u) for n, u in enumerate(URLS)] + [(4, URLS[4])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'x' as host", "'y' as verdict")
    want = sorted((str((n, *brute(u))) for n, u in rows))
    judged = lambda: sorted(str((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])) for r in url_filter.judge_urls(pages, BLOCK, ALLOW, HOSTS).collect())
    assert judged() == want
    monkeypatch.setattr(url_filter, "MAX_BITS", 30)
    assert url_filter.cascade_parts(7, 10) > 1 and judged() == want


def test_rules_as_tables(spark):
    pages = spark.createDataFrame([(n, u) for n, u in enumerate(URLS)], "page_id bigint, url string")
    rules = lambda some: spark.createDataFrame([*some, (None, "/"), ("q", None)], "h string, p string")
    hosts = spark.createDataFrame([(h,) for h in [*HOSTS, None, *(f"h{n}.example" for n in range(3000))]], "domain string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules(BLOCK), rules(ALLOW), hosts).collect()}
    assert got == {n: brute(u) for n, u in enumerate(URLS)}


def test_hundreds_of_rule_shapes(spark):
    block = [(".".join(["x"] * labels), "/" + "y" * n) for labels in range(1, 20) for n in range(20)]
    urls = [(labels * 100 + n, "http://" + ".".join(["x"] * labels) + "/" + "y" * n) for labels in (1, 7, 25) for n in (0, 5, 40)]
    got = {r["page_id"]: r["rule"] for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id bigint, url string"), block, []).collect()}
    assert got == {k: ".".join(["x"] * min(19, k // 100)) + "/" + "y" * min(19, k % 100) for k, _ in urls}


def test_cascade_is_exact(spark):
    listed = spark.range(0, 300).selectExpr("concat('k', id) as key")
    universe = spark.range(0, 20_000).selectExpr("concat('k', id) as key")
    cascade = url_filter.build_cascade(listed, universe, 20_000)
    assert len(cascade.levels) > 2
    got = universe.select("key", cascade.lists(universe["key"]).alias("in")).filter("in").collect()
    assert {r["key"] for r in got} == {f"k{n}" for n in range(300)}


def test_no_rules_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id bigint, url string")
    assert url_filter.judge_urls(pages, [], []).first()["verdict"] == "allow"
    assert url_filter.judge_urls(pages.limit(0), BLOCK, ALLOW, HOSTS).count() == 0
