"""From facts to the ledger's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import gocalls, govalues
from factgraph.operators.ownership import owned, resolve_tables
from factgraph.plans.materialize import written
from factgraph.plans.model import CONFIGS, Ledger
from factgraph.plans.prefix import numbered
from factgraph.sources.manifest import FILENAME, Manifest
from factgraph.sources.scan import ScanError


#: Kinds whose canonical name is their own in the whole project, so that links may cross files.
WIDE = ("package", "function", "route", "query")


def table_links(tables: DataFrame, placed: DataFrame, sources: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from queries to the one table of their service that they name, each with the evidence of the text, its literals and the declaration; and gaps for the others."""
    tables = tables.withColumn("target", F.when(F.col("schema") != "", F.concat("schema", F.lit("."), "table")).otherwise(F.col("table")))
    plain = tables.filter(~F.col("schema").contains(".") & ~F.col("table").contains("."))
    evidence = placed.filter("kind = 'table'").select(F.col("id").alias("asset_id"), "locator")
    assets = placed.select("id", "source_id", "kind", F.col("canonical").alias("canonical_name"))
    found = plain.join(resolve_tables(plain, assets, sources, evidence, configs), ["path", "target"])
    dotted = tables.join(plain.select("query").distinct(), "query", "left_anti").select("path", "locator", F.lit("A quoted name with a dot is outside the declarations that are read.").alias("reason"))
    gaps = found.filter("asset_id is null").select("path", "locator", "reason").unionByName(dotted)
    gaps = gaps.select(F.lit("go_unresolved_table").alias("code"), F.col("reason").alias("message"), "path", "locator")
    queries = placed.filter("kind = 'query'").select(F.col("canonical").alias("query"), F.col("id").alias("from_id"))
    linked = found.filter("asset_id is not null").join(queries, "query").join(evidence.withColumnRenamed("locator", "declared_at"), "asset_id").join(assets.select(F.col("id").alias("asset_id"), F.col("source_id").alias("declared_in")), "asset_id")
    type_ = F.when(F.col("access") == "read", "reads_table").otherwise("writes_table")
    at = F.explode(F.concat(F.array(F.struct("path", "locator")), "origins"))
    said = linked.select("from_id", F.col("asset_id").alias("to_id"), type_.alias("type"), at.alias("at")).join(sources.select(F.col("path").alias("at_path"), F.col("id").alias("source_id")), F.col("at.path") == F.col("at_path"))
    said = said.select("from_id", "to_id", "type", F.col("at.path").alias("path"), "source_id", F.col("at.locator").alias("locator"))
    own = linked.select("from_id", F.col("asset_id").alias("to_id"), type_.alias("type"), "path", F.col("declared_in").alias("source_id"), F.col("declared_at").alias("locator"))
    rows = said.unionByName(own).withColumn("origin", F.lit("source-derived")).withColumn("phase", F.lit(0)).withColumn("ordinal", F.lit(0))
    return rows.select("phase", "path", "ordinal", "from_id", "to_id", "type", "origin", "source_id", "locator"), gaps


def ledger_of(spark: SparkSession, facts: DataFrame, manifest: Manifest | None, manifest_sha256: str, metadata: dict[str, str], budget: tuple[int, int] | None = (govalues.MOST_STEPS, govalues.MOST_BYTES)) -> Ledger:
    """The ledger of a scan's facts; ScanError for a file's error or for an asset declared twice in a file.

    The evaluations of all files share a budget of steps and bytes, None for no bound. Ids follow phase, path and order of emission, without a gap; they are numbered by ranges (plans/prefix), so no task sees all rows and reruns agree.
    """
    bad = facts.filter("fact = 'error'").orderBy("path").select("path", "name").first()
    if bad is not None:
        raise ScanError(f"{bad.path}: {bad.name}")
    twice = facts.filter("fact = 'asset'").groupBy("path", "kind", "canonical").count().filter("count > 1").orderBy("path").first()
    if twice is not None:
        raise ScanError(f"{twice.path}: {twice.kind} {twice.canonical!r} is declared twice")
    tables = None
    if not facts.filter("fact = 'go' and kind = 'call'").isEmpty():
        facts, tables = gocalls.resolved(facts, budget)
        facts = written(facts, "facts-resolved")
    services = [(n, s.name, s.owner, s.source, s.domain, s.tags) for n, s in enumerate(manifest.services)] if manifest else []
    configs = spark.createDataFrame([s[1:] for s in services], CONFIGS)
    paths = facts.filter("fact = 'source'").select("path", F.lit(0).alias("phase"))
    hashes = facts.filter("fact = 'file'").select("path", F.col("name").alias("sha256"))
    at = paths.join(hashes, "path")
    if manifest:
        at = at.unionByName(spark.createDataFrame([(FILENAME, 1, manifest_sha256)], "path string, phase int, sha256 string"))
    sources = written(numbered(at, ["phase", "path"]).select("id", "path", "sha256"), "numbered-sources")
    declared = facts.filter("fact = 'asset'").select(F.lit(0).alias("phase"), "path", "ordinal", "kind", "name", "canonical", "attributes", "locator")
    # a package stands in each of its files: the first keeps it
    shared = declared.filter("kind = 'package'")
    packages = shared.groupBy("canonical").agg(F.min_by(F.struct(*declared.columns), "path").alias("p")).select("p.*")
    declared = declared.filter("kind <> 'package'").unionByName(packages)
    if services:
        rows = [(1, FILENAME, n, "service", name, name, {"owner": owner, "source": source} | ({"domain": domain} if domain else {}) | ({"tags": ",".join(tags)} if tags else {}), f"services.{name}") for n, name, owner, source, domain, tags in services]
        declared = declared.unionByName(spark.createDataFrame(rows, "phase int, path string, ordinal int, kind string, name string, canonical string, attributes map<string,string>, locator string"))
    placed = written(numbered(declared.join(sources.select("path", F.col("id").alias("source_id")), "path"), ["phase", "path", "ordinal"]), "numbered-assets")
    assets = placed.select("id", "source_id", "kind", "name", F.col("canonical").alias("canonical_name"), "attributes")
    ends = placed.select("path", "kind", "canonical", "id")
    edges = facts.filter("fact = 'edge'")
    starts = ends.toDF("path", "from_kind", "from_canonical", "from_id")
    goals = ends.toDF("path", "to_kind", "to_canonical", "to_id")
    within = edges.filter(~F.col("from_kind").isin(*WIDE)).join(starts, ["path", "from_kind", "from_canonical"]).join(goals, ["path", "to_kind", "to_canonical"])
    wide = lambda df, c: df.filter(F.col(c).isin(*WIDE)).drop("path")
    across = edges.filter(F.col("from_kind").isin(*WIDE)).join(wide(starts, "from_kind"), ["from_kind", "from_canonical"]).join(wide(goals, "to_kind"), ["to_kind", "to_canonical"])
    edges = within.unionByName(across)
    edges = edges.join(sources.select("path", F.col("id").alias("source_id")), "path").select(F.lit(0).alias("phase"), "path", "ordinal", "from_id", "to_id", "type", "origin", "source_id", "locator")
    if services:
        service_ids = assets.filter("kind = 'service'").select("name", F.col("id").alias("from_id"), F.col("source_id").alias("at"))
        owns = owned(assets, sources, configs).join(service_ids, "name")
        edges = edges.unionByName(owns.select(F.lit(1).alias("phase"), F.col("name").alias("path"), F.col("asset_id").cast("int").alias("ordinal"), "from_id", F.col("asset_id").alias("to_id"), F.lit("owns_asset").alias("type"), F.lit("source-derived").alias("origin"), F.col("at").alias("source_id"), F.concat(F.lit("services."), "name", F.lit(".source")).alias("locator")))
    more_gaps = None
    if tables is not None:
        linked, more_gaps = table_links(tables, placed, sources, configs)
        edges = edges.unionByName(linked)
    key = ["from_id", "to_id", "type", "origin"]
    edges = written(edges, "edges")
    relationships = written(numbered(edges.groupBy(*key).agg(F.min(F.struct("phase", "path", "ordinal")).alias("first")), ["first"]).select("id", *key), "numbered-relationships")
    null = F.lit(None).cast("long")
    of_assets = placed.select("source_id", F.col("id").alias("asset_id"), null.alias("relationship_id"), "locator")
    of_edges = edges.join(relationships, key).select("source_id", null.alias("asset_id"), F.col("id").alias("relationship_id"), "locator").distinct()
    # files that also stand for an asset: the other files of a package, the literals of a query or route
    beside = shared.select("kind", "canonical", "path", "locator").unionByName(facts.filter("fact = 'support'").select("kind", "canonical", "path", "locator"))
    beside = beside.join(placed.filter(F.col("kind").isin(*WIDE)).select("kind", "canonical", F.col("id").alias("asset_id")), ["kind", "canonical"])
    beside = beside.join(sources.select("path", F.col("id").alias("source_id")), "path").select("source_id", "asset_id", null.alias("relationship_id"), "locator")
    evidence = of_assets.unionByName(beside).distinct().unionByName(of_edges)
    evidence = numbered(evidence, ["asset_id", "relationship_id", "source_id", "locator"]).select("id", *evidence.columns)
    gaps = facts.filter("fact = 'gap'").select(F.col("kind").alias("code"), F.col("name").alias("message"), "path", "locator")
    gaps = gaps if more_gaps is None else gaps.unionByName(more_gaps)
    return Ledger(sources, assets, relationships, evidence, configs, gaps, hashes, metadata)
