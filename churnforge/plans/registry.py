"""The table of registered queries: name -> (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

REGISTRY: dict[str, tuple] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(c) -> "F.Column":
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
