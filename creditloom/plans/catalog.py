"""All registered queries by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditloom.sources.tables import Tables

MODULES = ["ledger_queries", "workbook_queries", "reconcile_queries", "text_queries", "findings_queries", "decision_queries", "retrieval_queries", "ml_queries"]


def _bind(job) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: job(Tables(spark, folder))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        module = importlib.import_module(f"creditloom.plans.{name}")
        for key, job in module.QUERIES.items():
            assert key not in found, key
            found[key] = _bind(job)
    return found
