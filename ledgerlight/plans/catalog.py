"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.plans import (  # noqa: F401
    explore_queries,
    feature_queries,
    ledger_queries,
    model_queries,
    report_queries,
    result_queries,
)
from ledgerlight.plans.registry import ENTRIES, Entry, assemble, present


def _runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: present(entry.run(spark, sf_dir), entry.layout)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(entry) for name, entry in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        name: assemble(entry.sql, entry.layout) for name, entry in ENTRIES.items() if entry.sql
    }
