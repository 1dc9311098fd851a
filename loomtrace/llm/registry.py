"""The registered queries of the subpackage and the SQL of those that plain SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["quality", "jaccard", "lines", "decontaminate", "packing", "toxicity", "secrets", "licenses", "revisits", "extraction",
           "urls", "tries", "centroids"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in import_module(f"loomtrace.llm.{module}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in import_module(f"loomtrace.llm.{module}").ORACLES.items()}
