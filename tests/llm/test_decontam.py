import re

import pytest

from millrace.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, window):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            k = min(window, len(v))
            for s in range(len(v) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit.update(range(p, p + k))
                        found.add(item)
        out.append((i, len(w), len(hit), sorted(str(x) for x in found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [1, 4, 10])
def test_contamination(spark, documents, prose, window):
    texts = dict(prose)
    items = [(1, " ".join(texts[5].split()[2:30])), (2, texts[8]), (10, "A b"), (11, ""), (12, None), (13, "..."), (14, "zzz unseen words"), (2, texts[8]), (15, "x"), (16, "Changed of the")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(documents, bench, window).collect()), key=str)
    assert got == brute(prose, items, window)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contamination(documents, none).filter("n_hit > 0").count() == 0
    assert decontam.contamination(documents.limit(0), none).count() == 0


def test_shuffled_joins_agree(spark, documents, prose, monkeypatch):
    bench = spark.createDataFrame([(1, dict(prose)[5])], "item_id bigint, text string")
    a = sorted(map(str, decontam.contamination(documents, bench).drop("spans").collect()))
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    assert sorted(map(str, decontam.contamination(documents, bench).drop("spans").collect())) == a


def test_index_holds_every_token(spark, documents, prose):
    index, rows = decontam.build_index(documents)
    got = sorted((r["row"], r["pos"], r["term"]) for r in index.collect())
    named = {r["row"]: r for r in rows.collect()}
    assert sorted((r["id"], r["n_words"]) for r in named.values()) == sorted((i, len(words(t))) for i, t in prose)
    texts = {}
    for row, pos, term in got:
        texts.setdefault(row, []).append(term)
        assert pos == len(texts[row]) - 1
    assert sorted((named[k]["id"], tuple(v)) for k, v in texts.items()) == sorted((i, tuple(words(t))) for i, t in prose if words(t))


def test_passage_in_every_document(spark):
    """A hot passage, once or twice in each row, and rows alike in all."""
    passage = " ".join(f"w{k % 7}" for k in range(14))
    docs = [(n % 30, f"a{n} {passage} b c {passage if n % 2 else ''} {n}") for n in range(60)]
    items = [(1, f"x {passage} y"), (2, "w0 w1 w2 w3 w4 w5 w6 w0 w1 w2")]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=str) == brute(docs, items, 10)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x y b"), (2, "b a"), (3, "a x y z b"), (4, None), (5, "A, B; a")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "q a"), (3, "a"), (4, "")], "query_id bigint, text string")
    got = {(r["doc_id"], r["query_id"]) for r in decontam.proximity_matches(docs, queries, 4).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), *((n, 3) for n in (1, 2, 3, 5))}
