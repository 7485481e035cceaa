"""Texts and styles derived from statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The styles of statuses.
STATUS_STYLE = {"queued": "gray", "running": "blue", "success": "green", "failed": "red"}


def status_style(status: Column) -> Column:
    """The style of a status; of an unknown one that of ``queued``."""
    styles = F.create_map(*[F.lit(x) for kv in STATUS_STYLE.items() for x in kv])
    return F.coalesce(F.try_element_at(styles, status), F.lit(STATUS_STYLE["queued"]))


def log_level(phase: Column, status: Column) -> Column:
    return F.when(status == "failed", "error").when(phase == "complete", "ok").otherwise("normal")


def passes_gate(accuracy: Column, auto_deploy: bool, threshold: float) -> Column:
    """Whether a model is deployed: if switched on, from the threshold up; a missing accuracy is 0."""
    return F.lit(auto_deploy) & (F.coalesce(accuracy, F.lit(0.0)) >= threshold)


def skip_reason(accuracy: Column, auto_deploy: bool, threshold: float) -> Column:
    """Why a model wasn't deployed; null if it was."""
    if not auto_deploy:
        return F.lit("auto deploy is off")
    return F.when(~passes_gate(accuracy, auto_deploy, threshold), f"accuracy below threshold {threshold:.2f}")


def readiness(ok: Column, good: str = "ok", bad: str = "degraded") -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), good).otherwise(bad)


def fixed4(x: Column) -> Column:
    """A number with four decimals, rounded by its exact binary value, halves away from zero; null stays null."""
    size = F.abs(x)
    scale = F.when(size < 8, F.lit(2.0**60)).otherwise(F.lit(2.0**44))
    whole = F.floor(size * scale)
    units = whole.cast("decimal(23,0)") * F.lit(10_000).cast("decimal(5,0)") + ((size * scale - whole) * 10_000).cast("decimal(20,8)")
    per = F.when(size < 8, F.lit(2**60).cast("decimal(20,0)")).otherwise(F.lit(2**44).cast("decimal(20,0)"))
    half = F.when(size < 8, F.lit(2**59).cast("decimal(20,0)")).otherwise(F.lit(2**43).cast("decimal(20,0)"))
    sum_ = (units + half).cast("decimal(36,8)")
    n = ((sum_ - sum_ % per) / per).cast("bigint")  # whole, so the division is exact
    text = F.concat(F.floor(n / 10_000).cast("string"), F.lit("."), F.lpad((n % 10_000).cast("string"), 4, "0"))
    exact = F.when((x < 0), F.concat(F.lit("-"), text)).otherwise(text)
    return F.when(size < 2.0**19, exact).when(x.isNotNull(), F.format_string("%.4f", x))


def value_text(value: Column) -> Column:
    """A metric (a variant) as the table shows it: numbers with four decimals, booleans and other values as text."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), fixed4(number)).when(kind != "VOID", F.try_variant_get(value, "$", "string"))


def health_rows(probes: DataFrame) -> DataFrame:
    """(service, status) of probes (service, ok): ok only if all of a service's are."""
    return probes.groupBy("service").agg(readiness(F.bool_and(F.coalesce("ok", F.lit(False)))).alias("status"))


def percent(x: Column) -> Column:
    return F.round(x * 100, 1)
