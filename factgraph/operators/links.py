"""Selecting assets, and the links around one: ends, direction, evidence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from factgraph.plans.model import SELECTOR_KINDS, Ledger


def candidates(assets: DataFrame, selector: str, kinds: tuple[str, ...] = SELECTOR_KINDS) -> DataFrame:
    """The assets that id:<n>, kind:<name> or a name, plain or canonical, select."""
    if m := re.fullmatch(r"id:([0-9]+)", selector):
        return assets.filter(F.col("id") == int(m[1]))
    kind, _, name = selector.partition(":")
    if not name or kind not in kinds:
        kind, name = "", selector
    found = assets.filter((F.col("name") == name) | (F.col("canonical_name") == name))
    return found.filter(F.col("kind") == kind) if kind else found


def resolve(assets: DataFrame, selector: str, kinds: tuple[str, ...] = SELECTOR_KINDS, shown: int = 20) -> Row:
    """The one asset selected; LookupError where there is none, or with the first candidates where there are several."""
    rows = candidates(assets, selector, kinds).orderBy("kind", "name", "id").limit(shown + 1).collect()
    if not rows:
        raise LookupError(f"no asset named {selector!r}")
    if len(rows) > 1:
        listed = ", ".join(f"id:{r.id} {r.kind}:{r.name}" for r in rows[:shown])
        raise LookupError(f"{selector!r} is ambiguous; use one of: {listed}" + ", ..." * (len(rows) > shown))
    return rows[0]


def links(ledger: Ledger, asset_id: int) -> DataFrame:
    """(direction, type, origin, from_*, to_*) of every relationship at an asset; a loop counts as incoming. Two equality filters, not a join on either end."""
    ends = ledger.relationships_at([asset_id])
    a = ledger.assets.select("id", "kind", "name")
    named = ends.join(a.toDF("from_id", "from_kind", "from_name"), "from_id").join(a.toDF("to_id", "to_kind", "to_name"), "to_id")
    return named.select(F.when(F.col("to_id") == asset_id, "incoming").otherwise("outgoing").alias("direction"), "type", "origin", "from_id", "from_kind", "from_name", "to_id", "to_kind", "to_name", F.col("id").alias("relationship_id"))


def ordered(found: DataFrame, by_origin: bool = True) -> DataFrame:
    """Outgoing links first, then by type, origin (in records, not in text) and ends."""
    return found.orderBy(F.col("direction") == "incoming", "type", *(["origin"] if by_origin else []), "from_kind", "from_name", "to_kind", "to_name", "relationship_id")


def evidence_lists(evidence: DataFrame, sources: DataFrame, target: str = "relationship_id") -> DataFrame:
    """(target, evidence): for each target one ordered list of (path, locator), in one grouped join."""
    at = evidence.filter(F.col(target).isNotNull()).join(sources.select(F.col("id").alias("source_id"), "path"), "source_id")
    return at.groupBy(target).agg(F.array_sort(F.collect_list(F.struct("path", "locator"))).alias("evidence"))


def explain(ledger: Ledger, asset_id: int) -> DataFrame:
    """An asset's links with their evidence."""
    found = links(ledger, asset_id)
    of = ledger.evidence_at([asset_id]).join(found.select("relationship_id").distinct(), "relationship_id", "left_semi")
    return ordered(found.join(evidence_lists(of, ledger.sources), "relationship_id", "left"))


def impact(ledger: Ledger, asset_id: int) -> DataFrame:
    """What depends on an asset in one step, and what it depends on: distinct neighbours by direction and type."""
    found = links(ledger, asset_id)
    other = lambda c: F.when(F.col("direction") == "incoming", F.col(f"from_{c}")).otherwise(F.col(f"to_{c}"))
    return found.select("direction", "type", other("id").alias("asset_id"), other("kind").alias("kind"), other("name").alias("name")).distinct()
