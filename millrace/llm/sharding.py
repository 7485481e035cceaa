"""Sharding by a k-d tree over row metadata.

The rows are split recursively at byte-weighted medians along the dimension
that is widest in the node, until each leaf holds the target bytes. A median is
found over all rows by narrowing counts: each pass sums the bytes of at most
4,096 buckets a node, all nodes of a level at once, and goes on within the
bucket where the median lies, until that bucket is within the tolerance. Sums
stay in DataFrames; the driver gets one row a node of the tree's current level,
which is broadcast and by which rows are dealt. A row's node follows from its
metadata alone, so the metadata table is written again every LEVELS levels only.

Equal texts have equal positions in every dimension, so they stay in one leaf
unless a group is so large that the bytes demand its split; then its rows are
parted by a hash of their ids, and rows alike in all by their number.

Defined results: a null text has size 1, as an empty one does; null metadata
counts as the least value; repeated rows are dealt each on its own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: Buckets (as bits) that one pass sums for a node; the part of a leaf's bytes that a split may be off by.
PASS_BITS, TOLERANCE = 12, 0.002
#: A split moves to a group's edge if that costs no more than this part of a leaf's bytes.
GROUP_TOLERANCE = 0.02
#: Rows numbered together in a shard; levels of the tree dealt before the table is written again.
SLOT_ROWS, LEVELS = 20_000, 4
#: Bits of positions; of the place within a group, so many are the row number's.
_BITS, _ROW_BITS = 62, 22


@dataclass
class Split:
    """Rows go left if they stand before (at, at_id) along ``dim``."""

    dim: int
    at: int
    at_id: int


def documents_metadata(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """(id, size, text_crc32, group_hash, id_hash and the dimensions), and the dimensions' names."""
    t = F.coalesce(F.col(text), F.lit(""))
    octets = F.octet_length(t).cast("bigint")
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    half = F.lit(2**31 - 1)
    out = docs.select(
        F.col(id_), (octets + 1).alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.xxhash64(t).bitwiseAND(half).alias("group_hash"), F.xxhash64(F.col(id_), t).alias("id_hash"),
        F.log2(octets + 1).alias("log_size"), (spaces / (octets + 1)).alias("space_rate"), (lines / (octets + 1)).alias("line_rate"), ((octets - F.length(t)) / (octets + 1)).alias("accent_rate"),
    )
    return out, ["log_size", "space_rate", "line_rate", "accent_rate"]


def _coded(df: DataFrame, dims: list[str]) -> DataFrame:
    """Each dimension as a position: its value scaled to 31 bits over the whole table, then the group's hash."""
    ends = df.agg(*[f(F.col(d)).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i, d in enumerate(dims):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        wide = (hi - lo) if lo is not None and hi > lo else 0
        code = F.floor((F.col(d) - lo) / wide * (2**31 - 1)).cast("bigint") if wide else F.lit(0).cast("bigint")
        out.append(F.shiftleft(F.coalesce(code, F.lit(0).cast("bigint")), 31) + F.col("group_hash"))
    return df.withColumn("p", F.array(*out))


def _with_parameters(rows: DataFrame, parameters: list[tuple], names: str) -> DataFrame:
    """``rows`` of the nodes in ``parameters`` (one tuple a node, at most one node a shard), with these."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(parameters, f"node int, {names}")), "node")


def _search(rows: DataFrame, goals: dict[int, float], slack: float) -> dict[int, tuple[int, float, float]]:
    """For each node a key such that about ``goals[node]`` bytes stand before it. ``rows`` has node, key and size.

    Gives (key, bytes before it, bytes at it): the last is 0 unless the key
    alone holds more than ``slack`` bytes around the goal.
    """
    state = {n: (0, _BITS, 0.0) for n in goals}  # low end, open bits, bytes before
    done: dict[int, tuple[int, float, float]] = {}
    while state:
        inside = _with_parameters(rows, [(n, at, open_, max(0, open_ - PASS_BITS), before, float(goals[n])) for n, (at, open_, before) in state.items()], "low bigint, width int, step int, before double, goal double")
        inside = inside.filter((F.col("key") >= F.col("low")) & (F.expr("shiftright(key - low, width)") == 0))
        sums = inside.groupBy("node", "goal", "before", F.expr("shiftright(key - low, step)").alias("bucket")).agg(F.sum("size").alias("bytes"))
        # a node's buckets, 4,096 at most, in order; the one that its goal lies in
        until = F.col("before") + F.sum("bytes").over(Window.partitionBy("node").orderBy("bucket"))
        crossing = F.when(F.col("until") > F.col("goal"), F.struct("bucket", "bytes", "until"))
        found = sums.withColumn("until", until).groupBy("node").agg(F.min(crossing).alias("at"), F.max("until").alias("all")).collect()
        got = {r["node"]: r for r in found}
        for n, (at, open_, before) in list(state.items()):
            step = max(0, open_ - PASS_BITS)
            r = got.get(n)
            if r is None or r["at"] is None:
                done[n] = (at + (1 << open_), before if r is None else r["all"], 0.0)
                del state[n]
                continue
            here, b = at + (r["at"]["bucket"] << step), r["at"]["bytes"]
            before = r["at"]["until"] - b
            if b <= slack:
                done[n] = (here, before, 0.0) if goals[n] - before <= before + b - goals[n] else (here + (1 << step), before + b, 0.0)
            elif step == 0:
                done[n] = (here, before, float(b))
            else:
                state[n] = (here, step, before)
                continue
            del state[n]
    return done


def kd_leaves(rows: DataFrame, dims: int, shards: int) -> DataFrame:
    """``rows`` (size, id_hash and p, the positions in ``dims`` dimensions) with ``shard`` instead of ``p``."""
    leaves, shard_of, first, level, written = {1: shards}, {}, {1: 0}, 0, None
    at = rows.withColumn("node", F.lit(1))
    while True:
        shard_of |= {n: first[n] for n, k in leaves.items() if k == 1}
        leaves = {n: k for n, k in leaves.items() if k > 1}
        if not leaves:
            break
        extent = at.groupBy("node").agg(F.sum("size").alias("bytes"), F.array(*[F.shiftright(F.max(F.col("p")[i]), 31) - F.shiftright(F.min(F.col("p")[i]), 31) for i in range(dims)]).alias("widths")).collect()
        total = {r["node"]: r["bytes"] for r in extent}
        widest = {r["node"]: max(range(dims), key=lambda i, r=r: r["widths"][i]) for r in extent}
        keyed = _with_parameters(at, [(n, widest.get(n, 0)) for n in leaves], "dim int").withColumn("key", F.get("p", F.col("dim")))
        goals = {n: total.get(n, 0) * (k // 2) / k for n, k in leaves.items()}
        leaf = max(1.0, sum(total.values()) / shards)
        found = _search(keyed.select("node", "key", "size"), goals, TOLERANCE * leaf)
        splits, hot = {}, {}
        for n, k in leaves.items():
            position, before, own = found[n]
            edge, off = min(((position, goals[n] - before), (position + 1, before + own - goals[n])), key=lambda x: x[1]) if own else (position, 0.0)
            splits[n] = Split(widest.get(n, 0), edge, 0)
            if off > GROUP_TOLERANCE * leaf * (k // 2):
                hot[n] = (position, goals[n] - before)
        if hot:
            group = _with_parameters(keyed, [(n, position) for n, (position, _) in hot.items()], "hot bigint").filter("key = hot").select("node", F.col("id_hash").alias("key"), "size")
            for n, (at_id, _, _) in _search(group, {n: goal for n, (_, goal) in hot.items()}, TOLERANCE * leaf).items():
                splits[n] = Split(widest.get(n, 0), hot[n][0], at_id)
        dealt = at.join(F.broadcast(rows.sparkSession.createDataFrame([(n, s.dim, s.at, s.at_id) for n, s in splits.items()], "node int, dim int, at bigint, at_id bigint")), "node", "left")
        place = F.get("p", F.col("dim"))
        left = (place < F.col("at")) | (place == F.col("at")) & (F.col("id_hash") < F.col("at_id"))
        at = dealt.withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).when(left, F.col("node") * 2).otherwise(F.col("node") * 2 + 1)).drop("dim", "at", "at_id")
        level += 1
        if level % LEVELS == 0:
            written, before = cut(at, "level"), written
            at = written
            if before is not None:
                discard(before)
        first |= {2 * n: first[n] for n in leaves} | {2 * n + 1: first[n] + k // 2 for n, k in leaves.items()}
        leaves = {2 * n: k // 2 for n, k in leaves.items()} | {2 * n + 1: k - k // 2 for n, k in leaves.items()}
    return _with_parameters(at, sorted(shard_of.items()), "shard int").drop("node", "p")


def kd_shards(rows: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, in ``shards`` leaves or as many as ``target_bytes`` asks for.

    ``rows`` has size, group_hash (31 bits) and id_hash (any long) besides the dimensions.
    """
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "metadata")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = shards or max(1, -(-total // (target_bytes or 1 << 30)))
    # rows alike in all stand apart by a hash of their number
    place = F.shiftleft(F.col("id_hash").bitwiseAND(F.lit(2 ** (_BITS - _ROW_BITS) - 1)), _ROW_BITS) + F.xxhash64("_row").bitwiseAND(F.lit(2**_ROW_BITS - 1))
    coded = _coded(rows.withColumn("id_hash", place), dims)
    return with_slots(kd_leaves(coded, len(dims), shards), shards, n).drop("_row")


def with_slots(dealt: DataFrame, shards: int, rows: int) -> DataFrame:
    """``slot``: gapless from 0 within each shard. Rows are numbered in buckets of their shard, on top of the buckets before."""
    buckets = max(8, -(-rows // (shards * SLOT_ROWS)))
    dealt = dealt.withColumn("_bucket", F.pmod("id_hash", F.lit(buckets)))
    counts = dealt.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("id_hash", "_row")).cast("bigint") - 1
    return dealt.join(before, ["shard", "_bucket"]).withColumn("slot", number + F.col("_before")).drop("_bucket", "_before")
