"""Every query of the signal operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import edits, kernels, listening, reports, signal, spectral, tables, views

FLAGSHIP = "gated_loudness"
_MODULES = (signal, spectral, tables, kernels, edits, views, reports, listening)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
