"""All queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.plans import entry, inputs, listings, logs, media, pages, ranking, records, routes, rules, shops, state, training, trees, urls

MODULES = [training, urls, pages, logs, state, ranking, records, inputs, routes, listings, trees, rules, shops, media, entry]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for module in MODULES for name, q in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
