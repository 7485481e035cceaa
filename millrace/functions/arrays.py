"""Nested data: notebooks, commits, maps, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cells_with_tag(cells: Column, tag: str) -> Column:
    """The cells that carry a tag; cells without tags don't."""
    return F.filter(cells, lambda c: F.coalesce(F.array_contains(c["metadata"]["tags"], tag), F.lit(False)))


def all_tags(cells: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.coalesce(cells, F.array()), lambda c: F.coalesce(c["metadata"]["tags"], F.array().cast("array<string>")))))


def missing(required: list[str], present: Column) -> Column:
    """The required values that aren't present, in their order."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(present, F.array().cast("array<string>")))


def source_text(source: Column) -> Column:
    """A cell's source as one string, whether it was a string or a JSON list of strings."""
    parts = F.from_json(source, "array<string>")
    return F.when(source.startswith("[") & parts.isNotNull(), F.array_join(parts, "")).otherwise(source)


def output_text(outputs: Column, limit: int = 2000) -> Column:
    """A cell's outputs, joined: stream text, else the plain-text data; at most ``limit`` characters."""
    one = lambda o: F.coalesce(o["text"], F.try_element_at(o["data"], F.lit("text/plain")), F.lit(""))
    return F.substring(F.array_join(F.transform(F.coalesce(outputs, F.array()), one), ""), 1, limit)


def changed_files(commits: Column) -> Column:
    """Added, then modified, files of each commit in order."""
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(F.coalesce(commits, F.array()), lambda c: F.concat(F.coalesce(c["added"], none), F.coalesce(c["modified"], none))))


def any_notebook(files: Column) -> Column:
    return F.exists(files, lambda f: f.endswith(".ipynb"))


def with_entry(map_: Column, key: str, value: Column) -> Column:
    """A map with one entry set."""
    return F.map_concat(F.map_filter(map_, lambda k, v: k != key), F.create_map(F.lit(key), value))


def number_or(json: Column, key: str, default: float) -> Column:
    """A number in a JSON object; the default if it is missing, no number, or the text no JSON."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(value, "$", "double"))
    return F.coalesce(number, F.lit(default))
