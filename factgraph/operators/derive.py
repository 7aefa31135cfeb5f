"""Conservative derived links: a schema and a table whose normalized names are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions.names import normalize_name
from factgraph.plans.model import Ledger


def name_links(assets: DataFrame) -> DataFrame:
    """(schema_id, table_id, key, schema_source_id, table_source_id): a hash join on the normalized name; names without letters or digits match each other."""
    a = assets.select("id", "source_id", "kind", normalize_name(F.col("name")).alias("key"))
    schemas = a.filter("kind = 'schema'").select("key", F.col("id").alias("schema_id"), F.col("source_id").alias("schema_source_id"))
    tables = a.filter("kind = 'table'").select("key", F.col("id").alias("table_id"), F.col("source_id").alias("table_source_id"))
    return schemas.join(tables, "key")


def build(ledger: Ledger, stamp: str) -> Ledger:
    """The ledger with its inferred links made anew, each with a row of evidence from either side."""
    kept = ledger.relationships.filter("origin <> 'inferred'")
    found = name_links(ledger.assets)
    new = found.select(F.xxhash64("schema_id", "table_id", F.lit("matches_table_name"), F.lit("inferred")).alias("id"), F.col("schema_id").alias("from_id"), F.col("table_id").alias("to_id"), F.lit("matches_table_name").alias("type"), F.lit("inferred").alias("origin"), "key", "schema_source_id", "table_source_id")
    proof = new.select(F.explode(F.array_distinct(F.array("schema_source_id", "table_source_id"))).alias("source_id"), F.col("id").alias("relationship_id"), F.concat(F.lit("normalized-name:"), "key").alias("locator"))
    proof = proof.select(F.xxhash64("source_id", "relationship_id", "locator").alias("id"), "source_id", F.lit(None).cast("long").alias("asset_id"), "relationship_id", "locator")
    gone = ledger.relationships.filter("origin = 'inferred'").select(F.col("id").alias("relationship_id"))
    evidence = ledger.evidence.join(gone, "relationship_id", "left_anti").select(ledger.evidence.columns).unionByName(proof)
    relationships = kept.unionByName(new.select(kept.columns))
    return Ledger(ledger.sources, ledger.assets, relationships, evidence, ledger.configs, ledger.diagnostics, ledger.files, ledger.metadata | {"last_build_at": stamp})
