"""Typed validation of JSON bodies: rows that pass, and refused ones with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BODIES

#: Variant types that a field's type takes.
_KINDS = {"string": "^STRING$", "array": "^ARRAY<", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$"}


def error_of(body: Column, kind: str) -> Column:
    """Why a body isn't a valid one of its kind; null if it is. The first field that is wrong is named; null counts as missing."""
    parsed = F.try_parse_json(body)
    out = F.when(parsed.isNull(), "body is not JSON").when(~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), "body is not an object")
    for name, type_, needed in BODIES[kind]:
        value = F.try_variant_get(parsed, f"$.{name}", "variant")
        found = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        if needed:
            out = out.when(found == "VOID", f"{name}: field required")
        out = out.when((found != "VOID") & ~found.rlike(_KINDS[type_]), f"{name}: not a valid {type_}")
    return out


def validated(rows: DataFrame, body: str, kind: str) -> DataFrame:
    """``rows`` with ``error``, null for valid bodies."""
    return rows.withColumn("error", error_of(F.col(body), kind))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("error is null").drop("error")


def refused(rows: DataFrame) -> DataFrame:
    return rows.filter("error is not null")
