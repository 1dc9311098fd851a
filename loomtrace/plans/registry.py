"""All registered queries: a Spark callable and, where plain SQL can express it, an independent oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["sources", "text", "signals", "rollups", "ingest", "joins", "sets", "gates", "similarity", "routing",
           "evaluation", "streaming", "hooks", "conditions"]


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


class Section(dict):
    """Collects the queries of one module."""

    def add(self, name: str, oracle: str | None = None):
        def register(fn):
            self[name] = Query(fn, oracle)
            return fn
        return register


@cache
def load() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in MODULES:
        for key, query in import_module(f"loomtrace.plans.{name}_queries").SECTION.items():
            if key in out:
                raise ValueError(f"query {key} registered twice")
            out[key] = query
    return out
