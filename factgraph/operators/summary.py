"""Counts of what a ledger holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.plans.model import Ledger

#: Kinds that a summary counts, in its order.
COUNTED = ("api", "operation", "schema", "table", "service", "package", "function", "route", "query")


def by_kind(assets: DataFrame) -> DataFrame:
    return assets.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def counters(assets: DataFrame, kinds: tuple[str, ...] = COUNTED) -> DataFrame:
    """One row with a counter per kind, 0 where there is none; other kinds are not counted."""
    return assets.agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds))


def by_type(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("type", "origin").agg(F.count(F.lit(1)).alias("n"))


def diagnostics(ledger: Ledger) -> DataFrame:
    """The gaps in their order; locators compare as strings."""
    return ledger.diagnostics.orderBy("path", "locator", "code", "message")
