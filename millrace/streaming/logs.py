"""Structured Streaming over event files: ingestion of pushes, live tails, run state."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.webhook import outcomes, parse_pushes
from ..schemas import TERMINAL_PHASES


def stream_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of a Parquet folder's files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stream_bodies(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of JSON files of requests: (event_id, event_type, body, signature), the body as it was signed. Broken lines give no row."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    parsed = lines.filter(F.try_parse_json("value").isNotNull()).select(F.from_json("value", "event_id bigint, event_type string, body string, signature string").alias("r"))
    return parsed.select("r.*").filter("event_id is not null")


def state_dir(spark: SparkSession) -> str:
    """A new folder for a stream's state, in the folder that all executors share; only on one machine a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/millrace-streams"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all there is now. Append goes to a file sink, exactly once; in update mode each batch writes its changed rows under its number, which a repeated batch replaces."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()


def newest_batch(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The current row of each key from the batches of ``drain`` in update mode."""
    batches = spark.read.parquet(out)
    kept = [c for c in batches.columns if c != "batch"]
    return batches.groupBy(key).agg(F.max_by(F.struct(*kept), "batch").alias("r")).select("r.*")


def ingest(pushes: DataFrame, repos: DataFrame, secret: str) -> DataFrame:
    """Push events with their outcome; a join of the stream with the static repositories, exact URL before URL + ``.git``."""
    parsed = parse_pushes(pushes, secret)
    known = repos.filter("is_active").groupBy("github_url").agg(F.min(F.struct("id", "branch")).alias("repo"))
    exact = known.select(F.col("github_url").alias("_exact"), F.col("repo").alias("_repo0"))
    suffixed = known.select(F.col("github_url").alias("_suffixed"), F.col("repo").alias("_repo1"))
    joined = parsed.join(exact, parsed["url"] == F.col("_exact"), "left").join(suffixed, F.concat("url", F.lit(".git")) == F.col("_suffixed"), "left")
    best = F.coalesce("_repo0", "_repo1")
    return outcomes(joined.withColumns({"repo_id": best["id"], "repo_branch": best["branch"]}).drop("_exact", "_suffixed", "_repo0", "_repo1"))


def live_tail(events: DataFrame, run) -> DataFrame:
    """A run's entries as they come."""
    return events.filter(F.col("pipeline_id") == run)


def follow(events: DataFrame, run, sink: Callable[[DataFrame, int], None], checkpoint: str, wait: float | None = None):
    """Sends a run's entries to ``sink`` until one is terminal, for ``wait`` seconds at most; gives the query."""
    ended: list[bool] = []

    def send(batch: DataFrame, n: int) -> None:
        sink(batch, n)
        if not batch.filter(F.col("phase").isin(TERMINAL_PHASES)).isEmpty():
            ended.append(True)

    query = live_tail(events, run).writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    began = time.monotonic()
    while query.isActive and not ended and (wait is None or time.monotonic() - began < wait):
        query.awaitTermination(1)
    if query.isActive:
        query.stop()
    return query


def run_state(events: DataFrame) -> DataFrame:
    """Each run's last phase and status and the number of its entries, kept by the aggregation's state."""
    return events.groupBy("pipeline_id").agg(F.max_by(F.struct("phase", "status"), "seq").alias("_last"), F.count(F.lit(1)).alias("n_events")).select("pipeline_id", F.col("_last.phase").alias("phase"), F.col("_last.status").alias("status"), "n_events")
