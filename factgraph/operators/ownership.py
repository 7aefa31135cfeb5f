"""Which service a path, and so an asset, belongs to: equi-joins of configured roots with the ancestors of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reasons that a gap of a table gives.
NO_SERVICE = "SQL source needs exactly one configured service root."
NO_TABLE = "No exact scanned DDL table matches inside the query's service."
MANY_TABLES = "Multiple scanned DDL tables match inside the query's service; schema or DDL scope is ambiguous."


def ancestors(path: Column) -> Column:
    """The path and every folder above it: a prefix join becomes an equi-join on one of these."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def owned(assets: DataFrame, sources: DataFrame, configs: DataFrame) -> DataFrame:
    """(name, owner, asset_id, kind): each service with every other asset under its root; overlapping roots give an asset several owners."""
    at = sources.select(F.col("id").alias("source_id"), F.explode(ancestors(F.col("path"))).alias("source_root"))
    roots = at.join(configs.select("name", "owner", "source_root"), "source_root")
    of = assets.filter("kind <> 'service'").select("id", "kind", "source_id").hint("merge")  # both sides grow with the ledger: neither is sent to all tasks
    return of.join(roots, "source_id").select("name", "owner", F.col("id").alias("asset_id"), "kind")


def unique_service(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, service) of (path): the one service whose root holds the path, or '' if none or several do."""
    distinct = paths.select("path").distinct()
    at = distinct.select("path", F.explode(ancestors(F.col("path"))).alias("source_root")).join(configs.select("name", "source_root"), "source_root")
    found = at.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    return distinct.join(found, "path", "left").select("path", F.when(F.col("n") == 1, F.col("name")).otherwise("").alias("service"))


def owners(relationships: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset_id, owner): the names of the services that own an asset."""
    services = assets.filter("kind = 'service'").select(F.col("id").alias("from_id"), F.col("name").alias("owner"))
    return relationships.filter("type = 'owns_asset'").join(services, "from_id").select(F.col("to_id").alias("asset_id"), "owner").distinct()


def teams(relationships: DataFrame, assets: DataFrame, configs: DataFrame) -> DataFrame:
    """(asset_id, team): the configured owners of an asset's services; a service's teams include its own."""
    of = owners(relationships, assets).unionByName(assets.filter("kind = 'service'").select(F.col("id").alias("asset_id"), F.col("name").alias("owner")))
    return of.join(configs.select(F.col("name").alias("owner"), F.col("owner").alias("team")), "owner").select("asset_id", "team").distinct()


def resolve_tables(references: DataFrame, assets: DataFrame, sources: DataFrame, evidence: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, target, service, matches, asset_id, reason) of references (path, target): a table links if exactly one row of evidence in the same service has its name.

    No service, no match and several matches each leave a reason instead of a link.
    """
    refs = references.select("path", "target").distinct().join(unique_service(references, configs), "path")
    tables = assets.filter("kind = 'table'").select(F.col("id").alias("asset_id"), "source_id", F.col("canonical_name").alias("target"))
    tables = tables.join(sources.select(F.col("id").alias("source_id"), "path"), "source_id")
    tables = tables.join(unique_service(tables, configs), "path").filter("service <> ''").drop("path")
    tables = tables.join(evidence.filter("asset_id is not null").select("asset_id", "locator"), "asset_id")
    found = tables.groupBy("service", "target").agg(F.count(F.lit(1)).alias("matches"), F.min("asset_id").alias("asset_id"))
    joined = refs.join(found, ["service", "target"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    reason = (
        F.when(F.col("service") == "", NO_SERVICE)
        .when(F.col("matches") == 0, NO_TABLE)
        .when(F.col("matches") > 1, MANY_TABLES)
        .otherwise("")
    )
    return joined.select("path", "target", "service", "matches", F.when(reason == "", F.col("asset_id")).alias("asset_id"), reason.alias("reason"))
