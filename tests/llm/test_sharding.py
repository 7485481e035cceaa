import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import queries, sharding


def shards(docs, **kw):
    rows, dims = sharding.documents_metadata(docs)
    return sharding.kd_shards(rows, dims, **kw).collect()


@pytest.mark.parametrize("n", [1, 3, 16])
def test_bytes_and_slots(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = shards(docs, shards=n)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    largest = max(r["size"] for r in got)
    assert len(got) == docs.count() and sorted(size) == list(range(n)) and max(size.values()) - min(size.values()) <= 2 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    whole = defaultdict(set)
    for r in got:
        whole[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in whole.values()) <= n


def test_hot_group_is_split(spark):
    rows = [(i, "same text " * 5) for i in range(600)] + [(1000 + i, f"other {i} " * (i % 9)) for i in range(300)] + [(5000, None), (5001, ""), (5001, "")]
    got = shards(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=8)
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == len(rows) and max(size.values()) < 1.1 * sum(size.values()) / 8


def test_repeated_rows_are_parted(spark):
    """600 rows alike in all beside 300 others."""
    rows = [(1, "same text " * 6)] * 600 + [(1000 + i, f"other {i} " * (i % 9)) for i in range(300)]
    got = shards(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=8)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and len(size) == 8 and max(size.values()) < 1.1 * sum(size.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_tree(rows, dims, k, leaf):
    """A k-d tree by sorting: (place, shard) of rows (p, place, size); splits stand at the edge of a position nearest to the median, or within it if it is too heavy."""
    if k == 1 or not rows:
        return {r[1]: 0 for r in rows}
    widths = [max(r[0][i] for r in rows) // 2**31 - min(r[0][i] for r in rows) // 2**31 for i in range(dims)]
    dim = widths.index(max(widths))
    goal = sum(r[2] for r in rows) * (k // 2) / k

    def crossing(items):
        before = 0
        for key, size in sorted(items.items()):
            if before + size > goal:
                return key, before, size
            before += size
        return None

    at = Counter()
    for p, _, size in rows:
        at[p[dim]] += size
    key, before, own = crossing(at)
    left, off = min(((key, goal - before), (key + 1, before + own - goal)), key=lambda x: x[1])
    inner = -1
    if off > sharding.GROUP_TOLERANCE * leaf * (k // 2):
        goal -= before
        left, inner = key, crossing({r[1]: r[2] for r in rows if r[0][dim] == key})[0]
    goes = lambda r: r[0][dim] < left or inner >= 0 and r[0][dim] == left and r[1] < inner
    a, b = [r for r in rows if goes(r)], [r for r in rows if not goes(r)]
    return plain_tree(a, dims, k // 2, leaf) | {place: n + k // 2 for place, n in plain_tree(b, dims, k - k // 2, leaf).items()}


@pytest.mark.parametrize("n", [5, 16])
def test_against_a_plain_tree(spark, monkeypatch, n):
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9000 + i, "copied " * 40) for i in range(300)], docs.schema))
    rows, dims = sharding.documents_metadata(docs)
    coded = sharding._coded(rows.withColumn("id_hash", rows["id_hash"].bitwiseAND(2**62 - 1)), dims).persist()
    held = [(tuple(r["p"]), r["id_hash"], r["size"]) for r in coded.collect()]
    want = plain_tree(held, len(dims), n, sum(x[2] for x in held) / n)
    got = {r["id_hash"]: r["shard"] for r in sharding.kd_leaves(coded, len(dims), n).collect()}
    coded.unpersist()
    assert len(held) == len(want) == 500 and got == want


def test_empty_and_target(spark, documents):
    assert shards(documents.limit(0), shards=4) == []
    total = sum(r["size"] for r in shards(documents, shards=1))
    assert len({r["shard"] for r in shards(documents, target_bytes=total // 3)}) in (3, 4)


def test_query_columns(spark):
    out = queries.op5_sharding(spark, "/root/testdata/sf0.001")
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
