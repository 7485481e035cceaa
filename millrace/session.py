"""Settings and sessions."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Settings of the platform; each can be set by an environment variable of its name in upper case."""

    webhook_secret: str = "test-secret"
    default_token: str = ""
    auto_deploy: bool = True
    deploy_threshold: float = 0.70
    endpoint: str = "http://model-server:8001"
    log_ttl_hours: int = 24
    log_buffer: int = 1000
    page_size: int = 20
    max_page_size: int = 100
    default_branch: str = "main"
    notebook_path: str = "notebooks/train.ipynb"

    @classmethod
    def from_env(cls) -> Settings:
        found = {}
        for f in fields(cls):
            text = os.environ.get(f.name.upper())
            if text is not None:
                kind = type(f.default)
                found[f.name] = text.strip().lower() in ("1", "true", "yes") if kind is bool else kind(text)
        return cls(**found)


@lru_cache(maxsize=1)
def settings() -> Settings:
    return Settings.from_env()


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` has underscores for dots."""
    builder = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
