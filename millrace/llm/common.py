"""Helpers that several operators share: tables, cut lineage, skewed lookups."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A hot key holds over 1/HOT_SHARE of the rows, so there are under HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Keys (numbers or digests) up to which a list of them is broadcast.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's readers open the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from the session.

    Only a session on one machine (as in tests) may name none: it gets a
    temporary folder, made once and kept for the session. On a cluster that
    would lose data, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


_cleaned: set[str] = set()


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Later stages start from the files, so a lost executor costs only the tasks
    it ran. ``discard`` removes the files; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if base not in _cleaned:
        _cleaned.add(base)
        atexit.register(_at_exit, spark, base)
    out = spark.read.schema(df.schema).parquet(path)
    _made.append((weakref.ref(out), path))
    return out


#: What ``cut`` made and wasn't removed, in order.
_made: list[tuple[weakref.ref, str]] = []


def discard(*frames: DataFrame) -> None:
    """Removes the files of frames that ``cut`` gave and that nothing unread depends on any more."""
    for held in [x for x in _made if any(x[0]() is df for df in frames)]:
        _made.remove(held)
        _remove(frames[0].sparkSession, held[1])


def made() -> int:
    """A mark for ``release``."""
    return len(_made)


def release(since: int, *kept: DataFrame) -> None:
    """Removes what ``cut`` has made since the mark, but for ``kept`` (at least one), and lets Spark remove shuffle files that nothing refers to."""
    spark = kept[0].sparkSession
    for held in [x for x in _made[since:] if not any(x[0]() is df for df in kept)]:
        _made.remove(held)
        _remove(spark, held[1])
    free(spark)


def free(spark: SparkSession) -> None:
    """Has the driver collect its garbage; with dead frames go their shuffle files, which else stay until it happens to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jvm is None:  # the session has been stopped
        return
    with contextlib.suppress(Exception):  # the gateway may already be gone
        _remove(spark, path)


def bitmap(places: DataFrame, size: int) -> Column:
    """A binary literal of ``size`` bits (a multiple of 64) with those at ``places`` (one column, longs) set; the driver gets ``size / 64`` words at most.

    A literal may stand in a lambda, as a subquery may not.
    """
    p = F.col(places.columns[0])
    words = places.groupBy(F.shiftright(p, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), p.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype="<i8")
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return F.lit(out.tobytes())


def has_bit(bits: Column, place: Column) -> Column:
    """Whether the bit at a place of a ``bitmap`` is set."""
    byte = F.conv(F.hex(F.substr(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def having(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose key is among ``keys`` (a written table of one column), or isn't; by a broadcast if they are few, else all rows are shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, keys.columns[0], how)


def skewed_left_join(rows: DataFrame, found: DataFrame, key: str, count: str, total: int, spread: Column) -> DataFrame:
    """``rows`` left-joined to ``found`` (one row a key), safe for hot keys.

    ``found[count]`` says how many of the ``total`` rows have the key. Keys over
    ``1/HOT_SHARE`` of the rows, of which there are under HOT_SHARE, are
    broadcast; their rows go to the second join under ``spread``, so that they
    don't meet in one task. Null keys find nothing.
    """
    limit = max(total // HOT_SHARE, 1)
    values = [c for c in found.columns if c not in (key, count)]
    hot = found.filter(F.col(count) > limit).select(key, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))
    cold = found.filter(F.col(count) <= limit).select(F.col(key).alias("_cold_key"), F.lit(False).alias("_cold_salted"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    joined = rows.join(F.broadcast(hot), key, "left")
    joined = joined.withColumn("_salted", F.coalesce(F.col("_hot"), F.col(key).isNull())).withColumn("_spread", F.when(F.col("_salted"), spread).otherwise(F.lit(0)))
    joined = joined.join(cold.withColumn("_cold_spread", F.lit(0)), (F.col(key) == F.col("_cold_key")) & (F.col("_salted") == F.col("_cold_salted")) & (F.col("_spread") == F.col("_cold_spread")), "left")
    kept = [c for c in rows.columns]
    return joined.select(*kept, *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cold_{c}")).alias(c) for c in values])
