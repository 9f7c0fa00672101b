"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brambling.plans import business, changes, dictionaries, fields, logs, markets, records, texts

FAMILIES = (logs, business, markets, texts, fields, records, dictionaries, changes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in FAMILIES for k, f in m.Q.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in FAMILIES for k, s in m.Q.sql.items()}
