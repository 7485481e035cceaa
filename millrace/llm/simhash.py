"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has a bit set where over half of its shingles' hashes have
it. Fingerprints are joined with themselves as a binary trie: a pair of nodes
is taken down together, a step into different children costs one bit of the
Hamming budget, and a pair is pruned when the budget is spent. The first levels
are taken by all keys at once, as rows: a row says in which node a key is a
guest (or at home) and how many bits it has spent on the way. Nodes that still
hold over GROUP rows go further down, the others are joined, each in one task,
so a group is bounded at every size of the corpus and nothing of the trie is in
the driver. Within a group only links that join two parts of it go out (a
spanning forest), so a large group of near copies gives as many links as it has
members. Components are found by contracting those links until none is left.

Near copies on word shingles (``copy_groups``) start from the trie's links and
check them on the whole sets. Fingerprints of 64 bits can't bring all pairs
alike to 0.8 together (such pairs differ in ten bits on average), so an exact
prefix join finds the links that are left.

Defined results: null and empty texts, and those of white space only, have no
words and the fingerprint zero, which is linked like any other; a text of fewer
words than a shingle has one shingle, the whole sequence; repeated rows share a
fingerprint and so a component; an empty table gives an empty result; other
columns, whatever their names, are ignored. Ids may have any type that can be
compared. A null id stays, with the component of its text; it is never chosen
as an id, so a component of null ids alone is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, free, having, made, release, skewed_left_join

#: Rows that are at home in a node of the first cut, about; rows of a group at most; levels that larger groups go down at once.
NODE_ROWS, GROUP, LEVELS = 1 << 13, 1 << 20, 6
#: Pairs of fingerprints compared at once at the foot of the trie.
LEAF_PAIRS = 1 << 14
#: Links that wait in a group before they are reduced to a forest.
PENDING = 1 << 21
#: Shingles hashed and counted at once.
CHUNK = 1 << 15
#: Differing bits of linked fingerprints.
BUDGET = 2
#: Near copies on word shingles: words in a shingle, similarity (Jaccard), the same in hundredths.
COPY_WORDS, COPY_SIMILARITY = 5, 0.8
PER_CENT = round(100 * COPY_SIMILARITY)
#: Sets that shingles are counted in to order them, the count of a frequent one, and such shingles at most.
SAMPLE_SETS, FREQUENT, MOST_FREQUENT = 20_000, 8, 1 << 16
#: Prefixes up to which a shingle may stand in without being put last, and shingles put last for that at most.
POPULAR, MOST_POPULAR = 8, 1 << 19
#: Open pairs a class up to which rounds end; sets of a shingle up to which all its pairs are compared; factor between steps of distances.
PAIRS_A_CLASS, BLOCK, STEP = 4, 16, 1.1


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 (UTF-8, seed 42) of a text's shingles of ``size`` words, repeats included, in chunks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < size:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    for i in range(0, len(starts), CHUNK):
        a, b = starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist()
        yield np.fromiter((h(joined[x:y], 42) for x, y in zip(a, b, strict=True)), dtype=np.uint64, count=len(a))


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How often each bit is set over the rows of an array of 64-bit words: full adders on whole columns of bits."""
    n, width = words.shape
    total = np.zeros(width * 64, dtype=np.int64)
    rows, weight = words, 1
    while len(rows):
        carries = []
        while len(rows) > 1:
            k = len(rows) // 3
            if k:
                a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                x = a ^ b
                carries.append((a & b) | (c & x))
                rows = np.concatenate((x ^ c, rows[3 * k :]))
            else:
                carries.append(rows[:1] & rows[1:2])
                rows = rows[:1] ^ rows[1:2]
        total += weight * _bits(rows[0])
        rows, weight = np.concatenate(carries) if carries else words[:0], weight * 2
    return total


def _bits(row: np.ndarray) -> np.ndarray:
    """The bits of 64-bit words, lowest first."""
    return np.unpackbits(row.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64)


def _spread(h: np.ndarray, width: int) -> np.ndarray:
    """``width`` 64-bit words from each hash: itself, then splitmix64 of it."""
    if width == 1:
        return h[:, None]
    out = np.empty((len(h), width), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = z ^ (z >> np.uint64(31))
    return out


def simhash(text: str | None, size: int, width: int = 1) -> bytes:
    """A text's fingerprint of ``width`` 64-bit words, big-endian."""
    n, total = 0, np.zeros(width * 64, dtype=np.int64)
    for h in shingle_hashes(text, size):
        total += bit_counts(_spread(h, width))
        n += len(h)
    return np.packbits(total * 2 > n, bitorder="little").view("<u8").astype(">u8").tobytes()


def with_fingerprint(df: DataFrame, size: int = 3, width: int = 1, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with ``text`` replaced by its fingerprint (binary, 8 bytes a word)."""
    kept = [c for c in df.columns if c not in (text, name)]
    schema = df.select(*kept).schema.add(name, "binary", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(x.as_py(), size, width) for x in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(prints, pa.binary())], names=[*kept, name])

    return df.select(*kept, text).mapInArrow(run, schema)


class Forest:
    """A spanning forest of links between 0..n-1 of least total distance.

    Links come in blocks. When more than PENDING wait, the forest so far and the
    waiting links are reduced to the forest of both, so memory is bounded.
    """

    def __init__(self, n: int):
        self.n = n
        self.links = np.zeros((0, 3), dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.count = 0

    def add(self, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> None:
        if len(i):
            self.waiting.append(np.column_stack((i, j, distance)))
            self.count += len(i)
            if self.count > PENDING:
                self.reduce()

    def reduce(self) -> np.ndarray:
        """The forest's links (i, j, distance)."""
        links = np.concatenate([self.links, *self.waiting])
        links = links[np.argsort(links[:, 2], kind="stable")]
        root, kept, at = np.arange(self.n), [], 0

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        step = 256
        while at < len(links):
            while not np.array_equal(up := root[root], root):
                root[:] = up
            rest = links[at:]
            apart = rest[root[rest[:, 0]] != root[rest[:, 1]]]
            for a, b, d in apart[:step].tolist():
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    kept.append((a, b, d))
            links, at = apart[step:], 0
            step = min(step * 2, 1 << 14)
        self.links, self.waiting, self.count = np.array(kept, dtype=np.int64).reshape(-1, 3), [], 0
        return self.links


def trie_links(left: np.ndarray, right: np.ndarray | None, bits: int, budget: int, found) -> None:
    """Calls ``found(i, j, differing)`` with the places of keys of at most ``budget`` differing bits.

    ``left`` and ``right`` are sorted 64-bit keys whose highest ``bits`` count;
    without ``right``, ``left`` is joined with itself.
    """
    own = right is None
    b = left if own else right
    stack = [(0, len(left), 0, len(b), 0, 0)]
    mask = np.uint64((2**bits - 1) << (64 - bits))
    while stack:
        al, ah, bl, bh, depth, spent = stack.pop()
        if al == ah or bl == bh:
            continue
        same = own and al == bl and ah == bh
        if depth == bits or (ah - al) * (bh - bl) <= LEAF_PAIRS:
            step = max(1, LEAF_PAIRS * 16 // (bh - bl))
            for at in range(al, ah, step):
                differ = np.bitwise_count((left[at : min(ah, at + step), None] ^ b[None, bl:bh]) & mask)
                i, j = np.nonzero(differ <= budget)
                d = differ[i, j]
                i, j = i + at, j + bl
                if same:
                    i, j, d = i[i < j], j[i < j], d[i < j]
                if len(i):
                    found(i, j, d)
            continue
        shift = np.uint64(63 - depth)
        head = (left[al] >> shift | np.uint64(1)) << shift
        am = al + int(np.searchsorted(left[al:ah], head))
        bm = am if same else bl + int(np.searchsorted(b[bl:bh], (b[bl] >> shift | np.uint64(1)) << shift))
        stack += [(al, am, bl, bm, depth + 1, spent), (am, ah, bm, bh, depth + 1, spent)]
        if spent < budget:
            stack.append((al, am, bm, bh, depth + 1, spent + 1))
            if not same:
                stack.append((am, ah, bl, bm, depth + 1, spent + 1))


def _deal(depth: int, step: int, budget: int):
    """Takes rows (home, side, spent, key) from trie depth ``depth`` to ``depth + step``.

    Side 0 is at home in the node, side 1 a guest whose path differs from the
    node's in ``spent`` bits. Of two nodes that have to meet one is the home; which
    one follows from their common bits, so that groups are even.
    """
    masks = [sum(1 << b for b in bits) for w in range(min(budget, step) + 1) for bits in combinations(range(step), w)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _large(batches):
            home, side, spent, key = (table.column(c).to_numpy() for c in ("home", "side", "spent", "key"))
            own = (key.view(np.uint64) >> np.uint64(64 - depth - step)).astype(np.int64) & ((1 << step) - 1)
            for mask in masks:
                other, w = own ^ mask, mask.bit_count()
                even = np.bitwise_count(own & other) % 2 == 0
                goes = np.where(side == 1, spent + w <= budget, (mask == 0) | (even & (other < own)) | (~even & (other > own)))
                k = np.flatnonzero(goes)
                if len(k):
                    columns = (home[k] * (1 << step) + other[k], np.where(mask == 0, side[k], 1).astype(np.int8), (spent[k] + w).astype(np.int8), key[k])
                    for at in range(0, len(k), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names=["home", "side", "spent", "key"])

    return run


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to CHUNK rows or more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def trie_self_join(keys: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS, group: int = GROUP) -> DataFrame:
    """Links (a, b) between ``keys`` (key long, distinct) that differ in ``budget`` bits at most.

    The links that come back connect what all links connect; of each group's
    links they are a forest of the nearest ones.
    """
    total = keys.count()
    rows = keys.select(F.lit(1).cast("bigint").alias("home"), F.lit(0).cast("tinyint").alias("side"), F.lit(0).cast("tinyint").alias("spent"), "key")
    schema, depth, step, links = "a bigint, b bigint", 0, max(1, (total // node_rows).bit_length()), None

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        (ka, kb) = (np.sort(pdf.loc[pdf["side"] == s, "key"].to_numpy().view(np.uint64)) for s in (0, 1))
        forest = Forest(len(ka) + len(kb))
        for k, shift in ((None, 0), (kb, len(ka))):

            def found(i: np.ndarray, j: np.ndarray, d: np.ndarray, shift=shift) -> None:
                forest.add(i, j + shift, d)

            if len(ka) and (k is None or len(k)):
                trie_links(ka, k, 64, budget, found)
        every = np.concatenate((ka, kb)).view(np.int64)
        found_links = forest.reduce()
        return pd.DataFrame({"a": every[found_links[:, 0]], "b": every[found_links[:, 1]]})

    while True:
        dealt = rows.mapInArrow(_deal(depth, step, budget), "home bigint, side tinyint, spent tinyint, key bigint")
        depth += step
        at_home = F.count_if(F.col("side") == 0)
        large = cut(dealt.groupBy("home").agg(at_home.alias("own"), F.count(F.lit(1)).alias("n")).filter((F.col("own") > 1) & (F.col("n") > group)).select("home"), "large")
        n = large.count() if depth + LEVELS <= 62 else 0
        done = (having(dealt, large, "left_anti") if n else dealt).select("home", "side", "key").groupBy("home").applyInPandas(join, schema)
        links = done if links is None else links.unionByName(done)
        if not n:
            return links
        rows, step = cut(having(dealt, large), "nodes"), LEVELS


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in ``links`` (a, b): the smallest id reachable.

    Each round moves every id to its smallest neighbour's and replaces the links
    by those between the ids moved to; parts shrink by half at least. The moves
    are then followed back from the last.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "moves")
        rounds.append(moved)
        joined = edges.join(moved.select(F.col("a"), F.col("to").alias("x")), "a").join(moved.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        after = cut(joined.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).filter("a <> b").distinct(), "links")
        discard(edges)
        edges = after
    discard(edges)
    if not rounds:
        return links.sparkSession.createDataFrame([], "id bigint, component bigint")
    out = rounds[-1].select(F.col("a").alias("id"), F.col("to").alias("component"))
    for moved in rounds[-2::-1]:
        later = out.select(F.col("id").alias("to"), F.col("component"))
        out = moved.join(later, "to", "left").select(F.col("a").alias("id"), F.coalesce("component", "to").alias("component"))
    out = cut(out, "components")
    discard(*rounds)
    return out


def simhash_components(df: DataFrame, id_: str = "doc_id", text: str = "text", words: int = 3, budget: int = BUDGET) -> DataFrame:
    """(id, fingerprint in hex, component_id): texts whose 64-bit fingerprints differ in ``budget`` bits at most are linked."""
    since = made()
    prints = cut(with_fingerprint(df.select(F.col(id_).alias("id"), F.col(text).alias("text")), words, 1), "prints")
    classes = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("key", _long("fingerprint", 0)), "classes")
    found = components(trie_self_join(classes.select("key"), budget))
    parted = classes.join(found.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = parted.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = parted.join(least, "component").select("fingerprint", "n", "component_id")
    total = classes.agg(F.sum("n")).first()[0] or 0
    label = cut(label, "labels")
    release(since, prints, label)
    out = skewed_left_join(prints, label, "fingerprint", "n", total, F.xxhash64("id"))
    return out.select(F.col("id").alias(id_), F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def _long(binary: str, word: int):
    """A big-endian 64-bit word of a binary column as a long (two halves, as ``conv`` is for unsigned text)."""
    half = lambda at: F.conv(F.hex(F.substring(F.col(binary), word * 8 + at, 4)), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(5))


def _least_shared(n: np.ndarray | int):
    """The fewest shingles that a set of ``n`` shares with one alike to it: COPY_SIMILARITY of them, rounded up."""
    return -(-PER_CENT * n // 100)


def _set(text: str | None) -> np.ndarray:
    """A text's distinct shingle hashes, ascending."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(text, COPY_WORDS)]))


def _ranks(tokens: np.ndarray, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The place of each shingle among the frequent ones (``known`` ascending, its ``ranks``), from one; zero for all others."""
    if not len(known):
        return np.zeros(len(tokens), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, ranks[at], 0)


def frequent_shingles(rows: DataFrame, total: int) -> np.ndarray:
    """Shingles that many of SAMPLE_SETS texts hold, rarest first. They only order the shingles: any order gives the same pairs."""
    some = rows if total <= SAMPLE_SETS else rows.filter(F.pmod(F.xxhash64("number"), F.lit(total)) < SAMPLE_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                found = _set(text.as_py()).view(np.int64)
                for i in range(0, len(found), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(found[i : i + (1 << 16)])], names=["token"])

    counts = some.select("text").mapInArrow(run, "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    got = counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    return got["token"].to_numpy()[::-1].view(np.uint64)


def popular_shingles(sets: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """The shingles that stand in over POPULAR of the prefixes of ``sets`` and then ``frequent``, rarest first.

    A sample can't tell a shingle that a hundred of many millions of texts hold;
    counted in all prefixes and put last, it leaves most of them. Like a sample it
    only orders the shingles.
    """
    counts = postings_of(sets).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > POPULAR)
    found = counts.orderBy(F.desc("n"), "token").limit(MOST_POPULAR).toArrow()["token"].to_numpy()[::-1].view(np.uint64)
    return np.concatenate((found[~np.isin(found, frequent)], frequent))


def shingle_prefixes(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(id, number, digest, key, size, plain, prefix) of ``rows`` (id, number, text).

    ``digest`` is that of the set of shingles, ``key`` its fingerprint, ``size`` its
    size; ``prefix`` holds the set's first shingles in an order common to all,
    frequent ones last; the first ``plain`` of them aren't frequent.

    A set of n shares s = _least_shared(n) shingles with any set alike to it, so
    the first shared one is among its first n - s + 1.
    """
    order = np.argsort(frequent)
    sent = rows.sparkSession.sparkContext.broadcast((frequent[order], (order + 1).astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = sent.value
        for batch in batches:
            out = []
            for text in batch.column("text"):
                own = _set(text.as_py())
                digest = blake2b(own.tobytes(), digest_size=16).digest()
                key = int(np.packbits(bit_counts(own[:, None]) * 2 > len(own), bitorder="little").view("<i8")[0])
                plain = most = len(own) - _least_shared(len(own)) + 1 if len(own) else 0
                n = len(own)
                rank = _ranks(own, known, ranks)
                if rank.any():
                    plain = min(most, int((rank == 0).sum()))
                    own = own[np.argsort(rank, kind="stable")]
                out.append((digest, key, n, plain, own[:most].tobytes()))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("number"), *columns], names=["id", "number", "digest", "key", "size", "plain", "prefix"])

    schema = rows.select("id", "number").schema
    for name, kind in (("digest", "binary"), ("key", "long"), ("size", "integer"), ("plain", "integer"), ("prefix", "binary")):
        schema = schema.add(name, kind, False)
    return rows.select("id", "number", "text").mapInArrow(run, schema)


def postings_of(prefixes: DataFrame) -> DataFrame:
    """(token, number, size, pos, often): a row for each shingle of each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, size, plain, held in zip(*(batch.column(c).to_pylist() for c in ("number", "size", "plain", "prefix")), strict=True):
                token = np.frombuffer(held, dtype=np.int64)
                for i in range(0, len(token), 1 << 16):
                    t = token[i : i + (1 << 16)]
                    pos = np.arange(i, i + len(t), dtype=np.int32)
                    columns = (t, np.full(len(t), number, dtype=np.int64), np.full(len(t), size, dtype=np.int32), pos, pos >= plain)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "number", "size", "pos", "often"])

    return prefixes.select("number", "size", "plain", "prefix").mapInArrow(run, "token bigint, number bigint, size int, pos int, often boolean")


def shared_postings(sets: DataFrame) -> DataFrame:
    """(token, number, size, pos) of the shingles that prefixes of several ``sets`` hold; of shingles that the same sets hold, of the first alone.

    The first shingle that two sets share is the first that all sets which hold it
    share, since the order is common, so no pair is lost and each passage counts
    once. Which sets hold a shingle is told by their number, the smallest and 128
    bits of hash. Shingles put last may be in very many sets, so no window is
    laid over those.
    """
    postings, columns = postings_of(sets), ["token", "number", "size", "pos"]
    held = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("number")), F.bit_xor(F.xxhash64("number", F.lit(1))), F.min("number"), F.sum("pos")]
    names, every = ["n", "x", "y", "least", "at"], Window.partitionBy("token")
    rare = postings.filter(~F.col("often")).select(*columns, "often", F.struct(*[c.over(every).alias(k) for c, k in zip(held, names, strict=True)]).alias("held")).filter("held.n > 1")
    rare = rare.withColumn("held", F.when(F.col("held.least") == F.col("number"), F.col("held")))
    counted = cut(rare.unionByName(postings.filter("often").select(*columns, "often"), allowMissingColumns=True), "counted")
    lists = counted.filter("often").groupBy("token").agg(*[c.alias(k) for c, k in zip(held, names, strict=True)]).filter("n > 1")
    lists = lists.unionByName(counted.filter("held is not null").select("token", "held.*"))
    first = cut(lists.groupBy(*names[:-1]).agg(F.min(F.struct("at", "token")).alias("first")).select("first.token"), "firsts")
    out = cut(having(counted, first).select(columns), "shared")
    discard(counted, first)
    return out


def _can_be_alike(a: str, b: str):
    """Whether two postings of one shingle may be the first that two alike sets share: by sizes, and by what follows it in both."""
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    after = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PER_CENT) & (after * (100 + PER_CENT) >= (n + m) * PER_CENT)


def _narrow(text: str | None) -> bytes:
    """A set's size and the distinct highest 16 bits of its hashes: a quarter of the set, which bounds what two sets share."""
    own = _set(text)
    return np.int32(len(own)).tobytes() + np.unique((own >> np.uint64(48)).astype(np.uint16)).tobytes()


def _may_be_alike(a: bytes, b: bytes) -> bool:
    """Whether sets of these ``_narrow`` forms can be alike: false only if they aren't."""
    (n, m), (x, y) = (int(np.frombuffer(s, dtype=np.int32, count=1)[0]) for s in (a, b)), (np.frombuffer(s, dtype=np.uint16, offset=4) for s in (a, b))
    most = min(len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y)), n, m)
    return most * 100 >= PER_CENT * (n + m - most)


def _are_alike(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared * 100 >= PER_CENT * (len(x) + len(y) - shared)


def _formed(rows: DataFrame, numbers: DataFrame, form) -> DataFrame:
    """(number, form): the ``form`` of the texts of those ``rows`` (number, text) that are among ``numbers``."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array([form(x.as_py()) for x in batch.column("text")], pa.binary())], names=["number", "form"])

    return having(rows.select("number", "text"), cut(numbers, "ids")).mapInArrow(forms, "number bigint, form binary")


def _compared(rows: DataFrame, pairs: DataFrame, form, good) -> DataFrame:
    """The ``pairs`` (a, b) of ``rows`` (number, text) that are ``good`` by the ``form`` of their texts."""
    own = cut(_formed(rows, pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct(), form), "compared")
    both = pairs.join(own.select(F.col("number").alias("a"), F.col("form").alias("x")), "a").join(own.select(F.col("number").alias("b"), F.col("form").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [good(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    out = cut(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "alike")
    discard(own)
    del both, own
    free(rows.sparkSession)
    return out


def alike(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of ``rows`` (number, text) whose sets are alike to COPY_SIMILARITY or more.

    What is shuffled for most pairs that aren't is a quarter of a set; the pairs
    that are left are compared on the whole sets.
    """
    near = _compared(rows, pairs, _narrow, _may_be_alike)
    out = _compared(rows, near, lambda text: _set(text).tobytes(), _are_alike)
    discard(near)
    return out


def _differing(own: np.ndarray, pivot: np.ndarray, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles that a set and a pivot don't share, in an order common to all sets: those the pivot lacks, rarest first; then the pivot's, those it has to itself last."""
    more, less = np.setdiff1d(own, pivot, assume_unique=True), np.setdiff1d(pivot, own, assume_unique=True)
    return np.concatenate((more[np.argsort(_ranks(more, known, ranks), kind="stable")], less[np.argsort(_ranks(less, known, ranks) == 0, kind="stable")]))


def _step(apart: np.ndarray | int) -> np.ndarray:
    return np.floor(np.log(np.maximum(apart, 1)) / np.log(STEP)).astype(np.int32)


def pivot_postings(rows: DataFrame, stars: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(pivot, token, step, number, part, size, apart, pos, nearer) for ``stars`` (number, part, pivot): prefixes of what sets and their pivots don't share.

    Let D be what a set x and the pivot don't share, ``apart`` its size, so two
    sets differ in what their D differ in. Sets alike of sizes n and m differ in
    d = (n + m) (1 - COPY_SIMILARITY) / (1 + COPY_SIMILARITY) shingles at most, so
    their D share (apart + apart' - d) / 2 or more: the first shared one is among
    the first d / 2 + 1 of the nearer set's and the first d + 1 of the other's, and
    these are what comes back. If none need be shared, both are alike to the
    pivot. Of many sets edited from one, D begins with what each has to itself,
    so those that aren't alike to the rest don't meet it. A nearer set's posting
    stands at each step of distance at which a set may be that it can be alike to.
    """
    order = np.argsort(frequent)
    sent = rows.sparkSession.sparkContext.broadcast((frequent[order], (order + 1).astype(np.int64)))
    own = cut(_formed(rows, stars.select("number").unionByName(stars.select(F.col("pivot").alias("number"))).distinct(), lambda text: _set(text).tobytes()), "compared")
    both = stars.join(own.withColumnRenamed("form", "x"), "number").join(own.select(F.col("number").alias("pivot"), F.col("form").alias("y")), "pivot").select("number", "part", "pivot", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = sent.value
        for batch in batches:
            for number, part, pivot, *held in zip(*(batch.column(c).to_pylist() for c in ("number", "part", "pivot", "x", "y")), strict=True):
                x, y = (np.frombuffer(h, dtype=np.uint64) for h in held)
                n, differ = len(x), _differing(x, y, known, ranks).view(np.int64)
                apart, most = len(differ), (n + 100 * n // PER_CENT) * (100 - PER_CENT) // (100 + PER_CENT)
                far = np.arange(min(apart, most + 1), dtype=np.int32)
                near = far[: most // 2 + 1]
                first, last = _step(apart), _step(apart + most - 2 * near)
                times = last - first + 1
                pos = np.concatenate((far, np.repeat(near, times)))
                step = np.concatenate((np.full(len(far), first), first + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))).astype(np.int32)
                for i in range(0, len(pos), 1 << 16):
                    k = slice(i, i + (1 << 16))
                    m = len(pos[k])
                    fixed = [np.full(m, v, dtype=t) for v, t in ((number, np.int64), (part, np.int64), (n, np.int32), (apart, np.int32))]
                    columns = (np.full(m, pivot, dtype=np.int64), differ[pos[k]], step[k], *fixed, pos[k], np.arange(i, i + m) >= len(far))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pivot", "token", "step", "number", "part", "size", "apart", "pos", "nearer"])

    out = cut(both.mapInArrow(run, "pivot bigint, token bigint, step int, number bigint, part bigint, size int, apart int, pos int, nearer boolean"), "differing")
    discard(own)
    return out


def _met_at_pivots(postings: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``pivot_postings``, which are removed, that may be alike sets of different parts."""
    keys = ["pivot", "token", "step"]
    several = postings.groupBy(*keys).agg(F.min("part").alias("least"), F.max("part").alias("most"), F.bool_or("nearer").alias("one"), F.bool_and("nearer").alias("all")).filter("least <> most and one and not all").select(*keys)
    rows = cut(postings.join(several, keys), "meeting")
    a, b = rows.filter("nearer").alias("a"), rows.filter(~F.col("nearer")).alias("b")
    n, m, x, y = F.col("a.size"), F.col("b.size"), F.col("a.apart"), F.col("b.apart")
    after = F.least(x - F.col("a.pos"), y - F.col("b.pos"))
    ordered = (x < y) | ((x == y) & (F.col("a.number") < F.col("b.number")))
    good = (F.least(n, m) * 100 >= F.greatest(n, m) * PER_CENT) & (2 * after * (100 + PER_CENT) >= (x + y) * (100 + PER_CENT) - (n + m) * (100 - PER_CENT))
    met = _pairs(a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.part") != F.col("b.part"), ordered, good]))
    discard(postings, rows)
    return met


def _middle(postings: DataFrame, turn: int) -> DataFrame:
    """One posting of each shingle: first of a set that has fewest rarer shingles, as the one has that others were edited from; in later turns of any set."""
    first = F.col("pos") if turn == 0 else F.lit(0)
    row = F.struct(first.alias("first"), F.xxhash64(F.col("number"), F.lit(turn)).alias("h"), "number", "size", "pos", "part")
    return postings.groupBy("token").agg(F.min(row).alias("m")).select("token", "m.number", "m.size", "m.pos", "m.part")


def alike_links(rows: DataFrame, postings: DataFrame, links: DataFrame, classes: int, frequent: np.ndarray) -> DataFrame:
    """``links`` (a, b) of alike sets and more of them, so that they connect what all pairs alike connect.

    ``postings`` (token, number, size, pos) hold each set's prefix. In a round
    each shingle's sets are compared with one of them; links found join parts,
    and only pairs between different parts stay open. When a round no longer
    halves the open pairs, or few are left, the rest is found: all open pairs of
    shingles of BLOCK sets or fewer are compared, the sets of each other shingle
    get one of them as a pivot and are compared if what they and the pivot don't
    share brings them together (``pivot_postings``).
    """
    before, turn = None, 0
    while True:
        parts = components(links)
        at = postings.join(parts, postings["number"] == parts["id"], "left").select("token", "number", "size", "pos", F.coalesce("component", "number").alias("part"))
        shares = at.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k"))
        open_ = cut(shares.groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("parts"), F.sum(F.col("k") * F.col("k")).alias("own")).filter("parts > 1").select("token", "n", ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")), "open")
        left = open_.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            return links
        at = cut(at.join(open_.select("token", "n"), "token"), "postings")
        if turn:
            discard(postings)
        discard(parts, open_)
        if left <= PAIRS_A_CLASS * classes or (before is not None and left > before / 2):
            break
        near = at.alias("a").join(_middle(at, turn).alias("b"), "token").filter("a.part <> b.part").filter(_can_be_alike("a", "b"))
        links = cut(links.unionByName(alike(rows, _pairs(near))), "links")
        postings = at.drop("n", "part")
        before, turn = left, turn + 1
    few = at.filter(F.col("n") <= BLOCK)
    rest = _pairs(few.alias("a").join(few.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.number") < F.col("b.number")) & (F.col("a.part") != F.col("b.part")) & _can_be_alike("a", "b")))
    pivots = _middle(at, 0).select("token", F.col("number").alias("pivot"), F.col("part").alias("pivot_part"))
    stars = cut(at.filter(F.col("n") > BLOCK).join(pivots, "token").filter("number <> pivot").select("number", "part", "pivot", "pivot_part").distinct(), "stars")
    if not stars.isEmpty():
        met = _met_at_pivots(pivot_postings(rows, stars.drop("pivot_part"), frequent))
        own = stars.filter("part <> pivot_part").select(F.least("number", "pivot").alias("a"), F.greatest("number", "pivot").alias("b"))
        rest = cut(rest.unionByName(met).unionByName(own).distinct(), "candidates")
    return cut(links.unionByName(alike(rows, rest)), "links")


def _pairs(met: DataFrame) -> DataFrame:
    return cut(met.select(F.least("a.number", "b.number").alias("a"), F.greatest("a.number", "b.number").alias("b")).distinct(), "candidates")


def _fingerprint_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of ``sets`` (number, key) that the trie join proposes and the check confirms."""
    first = cut(sets.groupBy("key").agg(F.min("number").alias("first")), "keys")
    joined = trie_self_join(first.select("key")).join(first.select(F.col("key").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("key").alias("b"), F.col("first").alias("y")), "b")
    same = sets.join(first, "key").select(F.col("first").alias("x"), F.col("number").alias("y")).filter("x <> y")
    return alike(rows, cut(joined.select("x", "y").unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "proposed"))


def copy_groups(rows: DataFrame) -> DataFrame:
    """(number, id, group, component_id) of ``rows`` (number, id, text): the groups that links of alike sets connect.

    ``number`` is a long of one's own for each row and ``rows`` can be read again (a
    table, or what ``cut`` gives), so a row belongs to the group of its own text
    whatever its id is. ``group`` is a number of the group's, ``component_id`` its
    smallest id. The join is exact: only texts of equal shingle sets are one class
    unchecked, fingerprints and then prefixes bring together every pair that
    can be alike, and each link is checked on the whole sets.
    """
    total, since = rows.count(), made()
    frequent = frequent_shingles(rows, total)
    prefixes = cut(shingle_prefixes(rows, frequent), "prefixes")
    classes = cut(prefixes.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("number").alias("number")), "classes")
    n_classes = classes.count()
    chosen = lambda: prefixes if n_classes == total else prefixes.join(classes.select("number"), "number", "left_semi")
    popular = popular_shingles(chosen(), frequent)
    if len(popular) > len(frequent):
        frequent, old = popular, prefixes
        prefixes = cut(shingle_prefixes(rows, frequent), "prefixes")
        discard(old)
        del old
    free(rows.sparkSession)
    links = _fingerprint_links(rows, chosen().select("number", "key"))
    found = components(alike_links(rows, shared_postings(chosen()), links, n_classes, frequent))
    grouped = classes.join(found, classes["number"] == found["id"], "left").select("digest", "rep", "n", F.coalesce("component", "number").alias("group"))
    first = grouped.groupBy("group").agg(F.min("rep").alias("component_id"))
    label = cut(grouped.join(first, "group").select("digest", "n", "group", "component_id"), "labels")
    members = cut(prefixes.select("number", "id", "digest"), "members")
    release(since, members, label)
    return skewed_left_join(members, label, "digest", "n", total, F.col("number")).select("number", "id", "group", "component_id")


def near_copies(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component_id): documents linked by word shingles alike to COPY_SIMILARITY or more (Jaccard, of their sets)."""
    rows = cut(df.select(F.col(id_).alias("id"), F.col(text).alias("text")).withColumn("number", F.monotonically_increasing_id()), "numbered")
    return copy_groups(rows).select(F.col("id").alias(id_), "component_id")
