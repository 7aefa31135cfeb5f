"""The ledger: typed assets, relationships, evidence and gaps as DataFrames, and the closed vocabularies they draw on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 3

# Schemas as DDL text: they need no session to be defined.
SOURCES = "id long, path string, sha256 string"
ASSETS = "id long, source_id long, kind string, name string, canonical_name string, attributes map<string,string>"
RELATIONSHIPS = "id long, from_id long, to_id long, type string, origin string"
EVIDENCE = "id long, source_id long, asset_id long, relationship_id long, locator string"
CONFIGS = "name string, owner string, source_root string, domain string, tags array<string>"
DIAGNOSTICS = "code string, message string, path string, locator string"
FILES = "path string, sha256 string"
TABLES = {"sources": SOURCES, "assets": ASSETS, "relationships": RELATIONSHIPS, "evidence": EVIDENCE, "configs": CONFIGS, "diagnostics": DIAGNOSTICS, "files": FILES}

# Kinds that a selector may name, attributes that leave the ledger in a pack, and the limits of a pack.
SELECTOR_KINDS = ("api", "channel", "function", "message", "operation", "package", "query", "route", "schema", "service", "table")
PACK_ATTRIBUTES = ("package", "receiver", "method", "path", "pattern", "operation", "table", "openapi", "asyncapi", "domain")
PACK_DEPTH, PACK_ASSETS, PACK_RELATIONSHIPS, PACK_EVIDENCE, PACK_GAPS = 4, 32, 64, 256, 64
#: Relationships that say where things belong, not how they work together.
STRUCTURAL = ("owns_asset", "contains")


@dataclass
class Ledger:
    sources: DataFrame
    assets: DataFrame
    relationships: DataFrame
    evidence: DataFrame
    configs: DataFrame
    diagnostics: DataFrame
    files: DataFrame
    metadata: dict[str, str] = field(default_factory=dict)
    #: Relationships at given assets, and evidence of those, where the ledger can find them without reading all.
    near: Callable[[list[int]], DataFrame] | None = None
    near_evidence: Callable[[list[int]], DataFrame] | None = None
    #: The commit that it was read from.
    commit: int = 0

    def relationships_at(self, ids: list[int]) -> DataFrame:
        """The relationships that begin or end at one of ids."""
        found = self.relationships if self.near is None else self.near(ids)
        return found.filter(F.col("from_id").isin(ids) | F.col("to_id").isin(ids))

    def evidence_at(self, ids: list[int]) -> DataFrame:
        """Evidence that holds at least all of that of the relationships at ids."""
        return self.evidence if self.near_evidence is None else self.near_evidence(ids)

    @classmethod
    def empty(cls, spark: SparkSession) -> Ledger:
        return cls(*(spark.createDataFrame([], s) for s in TABLES.values()))
