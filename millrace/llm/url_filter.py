"""URL filters by a Bloom filter cascade.

Level 1 is a Bloom filter of the listed keys; level 2 of those keys of the
corpus that pass level 1 but aren't listed; level 3 of the listed keys that pass
level 2, and so on until nothing passes wrongly. Because the levels encode the
complete key universe of the corpus, a key of it is listed if and only if the
first level that it fails has an even number (or it passes all of an odd
number): membership is exact, and testing it takes bit look-ups alone, no join.

Keys are rule strings, a host suffix followed by a path prefix. A rule fits a
host and all its subdomains if the url's path starts with the rule's; the
longest rule wins. Urls that no rule fits are judged by a list of hosts, held in
the same cascade.

The filters' size is bounded: level 1 takes 1.44 bits a listed key and halving
of the false-positive rate, and the rate is set so that later levels halve. What
grows with the corpus is one more bit a listed key each time the corpus
doubles. A list that would take over MAX_BITS is dealt into parts by a hash of
the key; each part has its own cascade, over the corpus's keys of that part, and
the urls are passed once a part.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed; repeated rows are judged alike; an empty
table or an empty list gives no blocks; null rules are no rules; extra columns
pass through unless named like an output.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, cut, has_bit

#: Bits of one cascade at most, about; and the levels after which building stops with an error.
MAX_BITS, MAX_LEVELS = 1 << 25, 64
#: Rules (host, path) as a list or as a table of both.
Rules = list[tuple[str, str]] | DataFrame
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass
class Level:
    """A Bloom filter: ``bits`` is a bitmap of ``size`` bits; ``number`` seeds its ``hashes``."""

    number: int
    size: int
    hashes: int
    bits: Column

    def has(self, key: Column) -> Column:
        return F.forall(_places(key, self.number, self.size, self.hashes), lambda p: has_bit(self.bits, p))


def _places(key: Column, level: int, size: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level * 1000 + k)), F.lit(size)) for k in range(hashes)])


def _level(keys: DataFrame, n: int, number: int, rate: float) -> Level:
    """A filter of the ``n`` distinct ``keys`` with about this rate of false positives; its bits are set on the executors."""
    hashes = max(1, round(-math.log2(rate)))
    size = max(64, -(-math.ceil(n * hashes / math.log(2)) // 64) * 64)
    return Level(number, size, hashes, bitmap(keys.select(F.explode(_places(F.col("key"), number, size, hashes)).alias("p")), size))


@dataclass
class Cascade:
    """Exact membership of the keys of a universe in a list."""

    levels: list[Level]

    def lists(self, key: Column) -> Column:
        out: Column = F.lit(len(self.levels) % 2 == 1)
        for number, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.has(key), F.lit(number % 2 == 1)).otherwise(out)
        return out


def cascade_rate(n: int, others: int) -> float:
    """Level 1's rate of false positives for ``n`` listed keys among ``others``."""
    return min(0.5, n * math.sqrt(0.5) / max(1, others))


def cascade_parts(n: int, others: int) -> int:
    """Parts that a list is dealt into, so that a cascade takes about MAX_BITS."""
    return max(1, math.ceil(n * (1.44 * math.log2(1 / cascade_rate(n, others)) + 8) / MAX_BITS)) if n else 1


def build_cascade(listed: DataFrame, universe: DataFrame, others: int) -> Cascade:
    """The cascade of ``listed`` (key) over ``universe`` (key) of about ``others`` distinct keys.

    Each level's filter runs over the universe before anything is shuffled, so
    what is made distinct is the listed keys' own size.
    """
    yes = cut(listed.select("key").filter("key is not null").distinct(), "listed")
    n = yes.count()
    if not n:
        return Cascade([])
    levels = [_level(yes, n, 0, cascade_rate(n, others))]
    no = cut(universe.select("key").filter(F.col("key").isNotNull() & levels[0].has(F.col("key"))).distinct().join(yes, "key", "left_anti"), "passed")
    ours, theirs = yes, no
    while (m := theirs.count()) and len(levels) < MAX_LEVELS:
        level = _level(theirs, m, len(levels), 0.5)
        levels.append(level)
        ours, theirs = theirs, cut(ours.filter(level.has(F.col("key"))), "passed")
    if m:
        raise RuntimeError(f"the cascade still passes {m} keys after {MAX_LEVELS} levels")
    return Cascade(levels)


def _table(spark: SparkSession, rules: Rules) -> DataFrame:
    """Rules as a table of (host, path)."""
    out = rules.toDF("host", "path") if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string")
    return out.filter("host is not null and path is not null").distinct()


def _candidates(shapes: list[tuple[int, int]]) -> Column:
    """The rule strings that could fit a row's (host, path): one for each (labels, path length) among the rules that its path is long enough for."""
    held = F.array(*[F.struct(F.lit(labels).alias("labels"), F.lit(n).alias("n")) for labels, n in shapes]) if shapes else F.array().cast("array<struct<labels:int,n:int>>")
    some = F.filter(held, lambda s: (F.length("path") >= s["n"]) & (F.col("host") != ""))
    return F.array_distinct(F.transform(some, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substr(F.col("path"), F.lit(1), s["n"]))))


def _parents(labels: list[int]) -> Column:
    """The host keys that could fit, one for each number of labels among the listed hosts."""
    held = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<int>")
    return F.array_distinct(F.transform(held, lambda n: F.concat(F.lit("host:"), F.call_function("substring_index", F.col("host"), F.lit("."), -n))))


def judge_urls(df: DataFrame, block: Rules, allow: Rules, hosts: list[str] | DataFrame = (), url: str = "url") -> DataFrame:
    """``df`` with host, path, rule (the longest that fits, else null) and verdict ('allow' or 'block').

    ``block`` and ``allow`` are rules (host, path), as lists or tables; of a rule
    in both, the block counts. ``hosts`` (a list, or a table of one column) are
    blocked with their subdomains where no rule fits. The driver gets the shapes of
    the rules (numbers of labels and path lengths) alone.
    """
    spark = df.sparkSession
    names = ["host", "path", "rule", "verdict"]
    rows = df.select(*[c for c in df.columns if c not in names or c == url]).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    blocks, allows = _table(spark, block), _table(spark, allow)
    bad = (hosts.toDF("host") if isinstance(hosts, DataFrame) else spark.createDataFrame([(h,) for h in hosts], "host string")).filter("host is not null")
    labels = F.size(F.split("host", "\\."))
    rules = cut(blocks.unionByName(allows).distinct().select(F.concat("host", "path").alias("key"), labels.alias("labels"), F.length("path").alias("n")), "rules")
    shapes = sorted((r["labels"], r["n"]) for r in rules.select("labels", "n").distinct().collect())
    fits, parents = _candidates(shapes), _parents(sorted(r["labels"] for r in bad.select(labels.alias("labels")).distinct().collect()))
    universe = rows.select(F.explode(F.concat(fits, parents)).alias("key"))
    listed = cut(rules.select("key").unionByName(bad.select(F.concat(F.lit("host:"), F.col("host")).alias("key"))).distinct(), "listed")
    n, others = listed.count(), universe.agg(F.approx_count_distinct("key", 0.02)).first()[0]
    parts = cascade_parts(n, others)
    part_of = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))
    none = F.lit(None).cast("struct<length:int,key:string>")
    rows = rows.withColumns({"_best": none, "_blocked": F.lit(False)})
    for part in range(parts):
        mine = (lambda key: part_of(key) == part) if parts > 1 else lambda key: F.lit(True)  # noqa: B023
        cascade = build_cascade(listed.filter(mine(F.col("key"))), universe.filter(mine(F.col("key"))), others // parts + 1)
        found = F.array_max(F.transform(F.filter(fits, lambda k: mine(k) & cascade.lists(k)), lambda k: F.struct(F.length(k).alias("length"), k.alias("key"))))  # noqa: B023
        rows = rows.withColumns({"_best": F.greatest("_best", found), "_blocked": F.col("_blocked") | F.exists(parents, lambda k: mine(k) & cascade.lists(k))})  # noqa: B023
        if parts > 1:
            rows = cut(rows, "judged")
    # which of the rules block is a list of its own, whose universe are the rules
    keys = cut(blocks.select(F.concat("host", "path").alias("key")).distinct(), "blocks")
    n_blocks, rows = keys.count(), rows.withColumn("rule", F.col("_best.key"))
    says: Column = F.lit(False)
    few = cascade_parts(n_blocks, n)
    for part in range(few):
        mine = (lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(few)) == part) if few > 1 else lambda key: F.lit(True)  # noqa: B023
        says = says | mine(F.col("rule")) & build_cascade(keys.filter(mine(F.col("key"))), rules.filter(mine(F.col("key"))), n // few + 1).lists(F.col("rule"))
        if few > 1:
            rows, says = cut(rows.withColumn("_says", says), "judged"), F.col("_says")
    verdict = F.when(F.when(F.col("rule").isNotNull(), says).otherwise(F.col("_blocked")), "block").otherwise("allow")
    return rows.withColumn("verdict", verdict).drop("_best", "_blocked", "_says")
