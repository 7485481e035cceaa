"""Runs folded from their event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import passes_gate, skip_reason
from ..schemas import TERMINAL_PHASES
from ..session import settings


def fold_updates(updates: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The current value of each column after partial updates: the last that isn't null."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return updates.groupBy(key).agg(*last)


def deployed(runs: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Successful runs whose JSON ``metrics`` say that their model was deployed."""
    said = F.try_variant_get(F.try_parse_json(metrics), "$.deployed", "variant")
    yes = F.when(F.schema_of_variant(said) == "BOOLEAN", F.try_variant_get(said, "$", "boolean"))
    return runs.filter((F.col("status") == "success") & F.coalesce(yes, F.lit(False)))


def with_deployment(runs: DataFrame, accuracy: str, auto_deploy: bool, threshold: float) -> DataFrame:
    """``runs`` with ``metrics`` (JSON, nulls written): the accuracy, whether it was deployed and else why not."""
    gate = passes_gate(F.col(accuracy), auto_deploy, threshold)
    held = F.struct(F.col(accuracy).alias("accuracy"), gate.alias("deployed"), skip_reason(F.col(accuracy), auto_deploy, threshold).alias("skip_reason"))
    return runs.withColumn("metrics", F.to_json(held, {"ignoreNullFields": "false"}))


def phase_list(events: DataFrame) -> DataFrame:
    """A run's phases in order, as an array."""
    one = F.struct("seq", "phase", "status", "ts")
    return events.groupBy("pipeline_id").agg(F.array_sort(F.collect_list(one)).alias("phases"))


def timeline(events: DataFrame, phases: list[str], mode: str = "last") -> DataFrame:
    """(pipeline_id, position, phase, status): a row for each run and phase; ``pending`` where it has no entry.

    ``mode`` 'last' shows a phase's last entry, 'first' its first.
    """
    pick = F.max_by if mode == "last" else F.min_by
    known = events.filter(F.col("phase").isin(phases)).groupBy("pipeline_id", "phase").agg(pick("status", "seq").alias("status"))
    entries = known.groupBy("pipeline_id").agg(F.map_from_entries(F.collect_list(F.struct("phase", "status"))).alias("found"))
    every = events.select("pipeline_id").distinct().join(entries, "pipeline_id", "left")
    out = every.select("pipeline_id", "found", F.posexplode(F.array(*map(F.lit, phases))).alias("position", "phase"))
    return out.select("pipeline_id", "position", "phase", F.coalesce(F.try_element_at("found", F.col("phase")), F.lit("pending")).alias("status"))


def run_status(events: DataFrame) -> DataFrame:
    """Each run's status: failed after an error or shutdown, success after complete, else running; and its first and last times."""
    failed = F.bool_or(F.col("phase").isin("error", "shutdown"))
    done = F.bool_or(F.col("phase") == "complete")
    status = F.when(failed, "failed").when(done, "success").otherwise("running")
    return events.groupBy("pipeline_id").agg(status.alias("status"), F.min("ts").alias("started_at"), F.max(F.when(F.col("phase").isin(TERMINAL_PHASES), F.col("ts"))).alias("finished_at"), F.count(F.lit(1)).alias("n_events"))


def stored_phases(events: DataFrame) -> DataFrame:
    """The entries that a run's stored phases hold: all but ``complete`` and ``shutdown``, which go to the live log alone."""
    return events.filter(~F.col("phase").isin("complete", "shutdown"))


def phase_durations(events: DataFrame) -> DataFrame:
    """Seconds from a phase's first to its last entry."""
    ms = F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))
    return events.groupBy("pipeline_id", "phase").agg((ms / 1000).alias("seconds"))


def tail(events: DataFrame, per: str = "pipeline_id", n: int | None = None) -> DataFrame:
    """The last ``n`` entries of each key."""
    w = Window.partitionBy(per).orderBy(F.col("seq").desc())
    return events.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= (n or settings().log_buffer)).drop("_n")


def replay(events: DataFrame, now: Column, hours: int | None = None) -> DataFrame:
    """The log entries of runs whose last entry is at most so many hours old; each entry renews its run."""
    since = now - F.make_dt_interval(hours=F.lit(hours or settings().log_ttl_hours))
    live = events.groupBy("pipeline_id").agg(F.max("ts").alias("_last")).filter(F.col("_last") >= since).select("pipeline_id")
    return events.join(live, "pipeline_id", "left_semi")


def until_terminal(events: DataFrame) -> DataFrame:
    """Entries up to each run's first terminal one."""
    end = events.filter(F.col("phase").isin(TERMINAL_PHASES)).groupBy("pipeline_id").agg(F.min("seq").alias("_end"))
    return events.join(end, "pipeline_id", "left").filter("_end is null or seq <= _end").drop("_end")
