import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import simhash


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return [b" ".join(w)] if 0 < len(w) < k else [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def brute_fingerprint(text):
    found = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def brute_components(ids, near):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(documents, prose):
    for budget in (2, 8):
        got = simhash.simhash_components(documents, budget=budget).collect()
        print_ = {}
        for i, t in prose:
            print_[i] = brute_fingerprint(t)
        want = brute_components(sorted(print_), lambda a, b: (print_[a] ^ print_[b]).bit_count() <= budget)  # noqa: B023
        assert len(got) == len(prose)
        assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{print_[i]:016x}", want[i]) for i in print_}


def joined(spark, keys, **how):
    """Components of the trie join's links, by brute force and as found."""
    df = spark.createDataFrame([(int(k.astype(np.int64)),) for k in keys], "key bigint")
    got = {r["id"]: r["component"] for r in simhash.components(simhash.trie_self_join(df, **how)).collect()}
    signed = [int(k.astype(np.int64)) for k in keys]
    want = brute_components(range(len(keys)), lambda a, b: int(np.bitwise_count(keys[a] ^ keys[b])) <= 2)
    least = {}
    for n, k in enumerate(signed):
        least[want[n]] = min(k, least.get(want[n], k))
    return {k: got.get(k, k) for k in signed}, {k: least[want[n]] for n, k in enumerate(signed)}


def test_small_nodes_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    keys = np.unique(np.concatenate([base ^ np.uint64(1) << np.uint64(s) for s in range(0, 64, 3)] + [base, base[:1] ^ np.uint64(6)]))
    for how in ({}, {"node_rows": 16}, {"node_rows": 16, "group": 20}, {"node_rows": 1 << 20, "group": 2}):
        got, want = joined(spark, keys, **how)
        assert got == want, how


def test_hot_node_is_cut_down(spark):
    """Keys that share their highest 40 bits: every level of the cut leaves them in one node until the group is bounded."""
    rng = np.random.default_rng(2)
    base = np.uint64(0xABCDEF0123 << 24)
    keys = np.unique(np.concatenate([base + rng.integers(0, 1 << 24, 1500, dtype=np.uint64), base + np.arange(8, dtype=np.uint64)]))
    got, want = joined(spark, keys, node_rows=64, group=500)
    assert got == want


def test_many_keys_of_one_node_in_bounded_groups(spark):
    """10^5 keys under one prefix of 26 bits: no group of the join gets more rows than asked, and planted neighbours are found."""
    rng = np.random.default_rng(3)
    keys = np.uint64(0x155AA33 << 38) + np.unique(rng.integers(0, 1 << 38, 100_000, dtype=np.uint64))
    near = np.setdiff1d(keys[::50] ^ np.uint64(1 << 7) ^ np.uint64(1 << 31), keys)
    df = spark.createDataFrame([(int(k.astype(np.int64)),) for k in np.concatenate((keys, near))], "key bigint")
    links = {tuple(sorted((r["a"], r["b"]))) for r in simhash.trie_self_join(df, node_rows=1 << 10, group=1 << 14).collect()}
    got = {r["id"]: r["component"] for r in simhash.components(spark.createDataFrame(sorted(links), "a bigint, b bigint")).collect()}
    pairs = [(int(k), int(k ^ np.uint64(1 << 7) ^ np.uint64(1 << 31))) for k in keys[::50]]
    assert all(got[a] == got[b] for a, b in pairs)


def test_ids_of_text_and_null(spark, documents, prose):
    rows = [(None if i % 7 == 0 else f"d{i}", t, i) for i, t in prose]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id string, text string, component bigint")).collect()
    print_ = {k: brute_fingerprint(t) for k, (_, t, _) in enumerate(rows)}
    part = brute_components(range(len(rows)), lambda a, b: (print_[a] ^ print_[b]).bit_count() <= 2)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[part[k]] = min(i, least.get(part[k], i))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(key((i, f"{print_[k]:016x}", least.get(part[k]))) for k, (i, _, _) in enumerate(rows))


def test_near_copies(documents, prose):
    sets = {i: set(shingles(t, 5)) for i, t in prose}
    alike = lambda a, b: (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents).collect()}
    assert got == brute_components(sorted(sets), alike)


def near_groups(spark, texts):
    got = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return {r["doc_id"]: r["component_id"] for r in got}


def brute_near_groups(texts):
    sets = [set(shingles(t, 5)) for t in texts]
    return brute_components(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


def test_near_copies_at_the_bound(spark, monkeypatch):
    """Groups in which nearly half of the pairs are just below the similarity; compared at once, and by rounds in small blocks."""
    rng = np.random.default_rng(4)
    texts = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(204)]
        for n in range(40):
            own = list(base)
            start = int(rng.integers(0, 204))
            for k in range(int(rng.integers(17, 22))):
                own[(start + k) % 204] = f"x{g}n{n}k{k}"
            texts.append(" ".join(own))
    want = brute_near_groups(texts)
    assert near_groups(spark, texts) == want
    monkeypatch.setattr(simhash, "PAIRS_A_CLASS", 0)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    assert near_groups(spark, texts) == want


def test_repeated_line_makes_no_copies(spark):
    """Different texts around one line repeated often; of two copies only the counts differ."""
    line = "one two three four five six seven"
    own = lambda n: " ".join(f"n{n}k{k}" for k in range(300))
    texts = [f"{own(n)} " + " ".join([line] * 200) for n in range(4)] + [f"{own(3)} " + " ".join([line] * 90)]
    assert near_groups(spark, texts) == brute_near_groups(texts) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}


def test_short_near_copies_are_all_found(spark):
    """Pairs at the similarity exactly, of four to 24 shingles and one more in every fourth: none may be missed."""
    texts = []
    for n in range(300):
        k = 4 * (1 + n % 6)
        text = " ".join(f"p{n}w{i}" for i in range(k + 4))
        texts += [text, text + "".join(f" p{n}end{i}" for i in range(k // 4))]
    got = near_groups(spark, texts)
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_components_of_chains(spark):
    chain = [(n, n + 1) for n in range(60)] + [(100, 105), (105, 103), (7, 7)]
    got = {r["id"]: r["component"] for r in simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {n: 0 for n in range(61)} | {100: 100, 103: 100, 105: 100}
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.simhash_components(empty).count() == 0 and simhash.near_copies(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=0, max_size=40))
def test_bit_counts(values):
    got = simhash.bit_counts(np.array(values, dtype=np.uint64).reshape(-1, 1))
    assert got.tolist() == [sum(v >> b & 1 for v in values) for b in range(64)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 3))
def test_trie_links(values, budget):
    keys = np.sort(np.array(values, dtype=np.uint64))
    found = set()
    old, simhash.LEAF_PAIRS = simhash.LEAF_PAIRS, 2
    try:
        simhash.trie_links(keys, None, 64, budget, lambda i, j, d: found.update(zip(i.tolist(), j.tolist(), strict=True)))
    finally:
        simhash.LEAF_PAIRS = old
    assert found == {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(np.bitwise_count(keys[i] ^ keys[j])) <= budget}


def edited(rng, base, n, edits):
    """A text of ``base`` with ``edits`` of its words, far from each other, replaced by its own."""
    own = list(base)
    for k in rng.permutation(len(base) // 6)[:edits]:
        own[6 * int(k) + 2] = f"x{n}k{k}"
    return " ".join(own)


def test_sets_around_one_are_not_compared_with_each_other(spark, monkeypatch):
    """Sets edited from one, most of them alike to it and not to each other: candidates grow as the group, not its square."""
    rng, base, counts = np.random.default_rng(5), [f"w{k}" for k in range(304)], []
    compared = simhash._compared

    def counting(rows, pairs, form, good):
        counts.append(pairs.count())
        return compared(rows, pairs, form, good)

    monkeypatch.setattr(simhash, "_compared", counting)
    texts = [edited(rng, base, n, int(rng.integers(4, 8))) for n in range(180)] + [" ".join(base)]
    assert near_groups(spark, texts) == brute_near_groups(texts)
    assert max(counts) < 6 * len(texts)


def test_pivots_lose_no_pair(spark, monkeypatch):
    """Groups around texts that aren't in the table, by additions, deletions and replacements, with chains, through every path."""
    rng = np.random.default_rng(6)
    texts = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(60 + 50 * g)]
        for n in range(30):
            own = list(base)
            for _ in range(int(rng.integers(1, 4))):
                at, length = int(rng.integers(0, len(own) - 8)), int(rng.integers(1, 8))
                own[at : at + length] = [f"g{g}e{rng.integers(0, 6)}w{k}" for k in range(int(rng.integers(0, 8)))]
            texts.append(" ".join(own))
    want = brute_near_groups(texts)
    assert len(set(want.values())) > 8
    monkeypatch.setattr(simhash, "BLOCK", 2)
    for pairs, frequent in ((4, 8), (0, 1000)):
        monkeypatch.setattr(simhash, "PAIRS_A_CLASS", pairs)
        monkeypatch.setattr(simhash, "FREQUENT", frequent)
        assert near_groups(spark, texts) == want


def shared(spark, texts, monkeypatch):
    """The groups of ``texts``, and how many postings went into their comparison."""
    counts, links = [], simhash.alike_links

    def counting(rows, postings, *rest):
        counts.append(postings.count())
        return links(rows, postings, *rest)

    monkeypatch.setattr(simhash, "alike_links", counting)
    return near_groups(spark, texts), counts[0]


def test_a_shared_passage_counts_once(spark, monkeypatch):
    """Pairs below the similarity share some 50 shingles of their prefixes, which the same two sets hold: one posting each."""
    rng = np.random.default_rng(7)
    texts = [edited(rng, [f"g{g}w{k}" for k in range(304)], 10 * g + n, 8) for g in range(40) for n in range(2)]
    got, n = shared(spark, texts, monkeypatch)
    assert got == brute_near_groups(texts) and n == len(texts)


def test_shingles_that_a_sample_misses_are_put_last(spark, monkeypatch):
    """Two lines that 120 texts hold, of which a sample of about ten shows nothing: no prefix needs them."""
    monkeypatch.setattr(simhash, "SAMPLE_SETS", 10)
    monkeypatch.setattr(simhash, "FREQUENT", 100)
    lines = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    texts = [f"{lines[0]} " + " ".join(f"n{n}k{k}" for k in range(60)) + f" {lines[1]}" for n in range(120)]
    got, n = shared(spark, texts, monkeypatch)
    assert got == {i: i for i in range(120)} and n == 0
