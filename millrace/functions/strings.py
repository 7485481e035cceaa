"""Strings and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def owner_of(url: Column) -> Column:
    """The owner in a repository URL; null if it isn't one."""
    return F.nullif(F.regexp_extract(url, r"github\.com[/:]([^/]+)/([^/.]+)", 1), F.lit(""))


def repo_of(url: Column) -> Column:
    """The repository's name, which ends at its first dot; null if the URL isn't one."""
    return F.nullif(F.regexp_extract(url, r"github\.com[/:]([^/]+)/([^/.]+)", 2), F.lit(""))


def display_name(url: Column) -> Column:
    """The URL's path without the first slash and ``.git``; a text that is no URL stays as it is."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.coalesce(F.regexp_replace(F.regexp_replace(path, "^/", ""), r"\.git$", ""), url)


def branch_of(ref: Column) -> Column:
    """A ref without ``refs/heads/``, wherever it stands."""
    return F.replace(ref, F.lit("refs/heads/"), F.lit(""))


def mask_token(token: Column) -> Column:
    """Four stars and the last four characters; only the stars if there are fewer."""
    return F.when(F.length(token) >= 4, F.concat(F.lit("****"), F.right(token, F.lit(4)))).otherwise(F.lit("****"))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty; the last one as it is."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def trim_or(text: Column, default: str) -> Column:
    """The trimmed text, or the default if nothing is left."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def short(text: Column, n: int = 7) -> Column:
    return F.substring(text, 1, n)


def strip_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def is_repo_url(url: Column) -> Column:
    """Whether a text has the shape of a repository's web address."""
    return url.rlike(r"^https://github\.com/[\w.\-]+/[\w.\-]+/?$")


def endpoint_url(model: Column, server: str) -> Column:
    return F.concat(F.lit(f"{server}/predict/"), model)


def assignment(source: Column, name: str, default: str) -> Column:
    """The first quoted value assigned to ``name`` in a source text, wherever it stands; else the default."""
    found = F.regexp_extract(source, rf"(?U){name}\s*=\s*['\"]([^'\"]+)['\"]", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))
