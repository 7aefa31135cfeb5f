"""A ledger projected from star-schema tables, by column arithmetic alone: ids are key * 8 + kind, so no step numbers rows globally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions.identity import fingerprint
from factgraph.operators.ownership import owned
from factgraph.plans.model import DIAGNOSTICS, Ledger

SERVICE, CUSTOMER, SUPPLIER, ORDER, PART = range(5)
#: The types of relationships; a row that declares one carries its place here until it has been moved.
TYPES = ("places", "contains_part", "supplied_by", "owns_asset")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(column: str, kind: int) -> Column:
    return F.col(column).cast("long") * 8 + kind


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


class Star:
    """The tables of one folder as a ledger; each table is a plan of its own, so a query reads only what it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, t = spark, lambda n: table(spark, sf_dir, n)
        self.nation, self.region, self.customer, self.supplier = t("nation"), t("region"), t("customer"), t("supplier")
        self.part, self.orders, self.lineitem = t("part"), t("orders"), t("lineitem")

    def sources(self) -> DataFrame:
        def row(df: DataFrame, id_: Column, path: Column, content: Column) -> DataFrame:
            return df.select(id_.alias("id"), path.alias("path"), fingerprint(content).alias("sha256"))

        return (
            row(self.nation, key("n_nationkey", SERVICE), text("services/", F.col("n_nationkey")), F.col("n_name"))
            .unionByName(row(self.customer, key("c_custkey", CUSTOMER), text("nation/", F.col("c_nationkey"), "/customer/", F.col("c_custkey")), text(F.col("c_name"), "|", F.col("c_mktsegment"))))
            .unionByName(row(self.supplier, key("s_suppkey", SUPPLIER), text("nation/", F.col("s_nationkey"), "/supplier/", F.col("s_suppkey")), F.col("s_name")))
            .unionByName(row(self.part, key("p_partkey", PART), text("catalog/", F.col("p_brand"), "/", F.col("p_partkey")), text(F.col("p_name"), "|", F.col("p_type"))))
        )

    def assets(self) -> DataFrame:
        def row(df: DataFrame, kind: str, id_: Column, source: Column, name: Column, canonical: Column, **attributes: str) -> DataFrame:
            pairs = [x for k, c in attributes.items() for x in (F.lit(k), F.col(c).cast("string"))]
            return df.select(id_.alias("id"), source.alias("source_id"), F.lit(kind).alias("kind"), name.alias("name"), canonical.alias("canonical_name"), F.create_map(*pairs).alias("attributes"))

        return (
            row(self.nation, "service", key("n_nationkey", SERVICE), key("n_nationkey", SERVICE), F.col("n_name"), F.col("n_name"), domain="n_regionkey")
            .unionByName(row(self.customer, "customer", key("c_custkey", CUSTOMER), key("c_custkey", CUSTOMER), F.col("c_name"), F.col("c_name"), segment="c_mktsegment"))
            .unionByName(row(self.supplier, "supplier", key("s_suppkey", SUPPLIER), key("s_suppkey", SUPPLIER), F.col("s_name"), F.col("s_name"), path="s_nationkey"))
            .unionByName(row(self.orders, "order", key("o_orderkey", ORDER), key("o_custkey", CUSTOMER), text("order ", F.col("o_orderkey")), text("order/", F.col("o_orderkey")), operation="o_orderstatus"))
            .unionByName(row(self.part, "part", key("p_partkey", PART), key("p_partkey", PART), F.col("p_name"), text("part/", F.col("p_partkey")), package="p_brand", pattern="p_type"))
        )

    def configs(self) -> DataFrame:
        joined = self.nation.join(self.region, self.nation["n_regionkey"] == self.region["r_regionkey"])
        return joined.select(F.col("n_name").alias("name"), F.col("r_name").alias("owner"), text("nation/", F.col("n_nationkey")).alias("source_root"), F.lit("").alias("domain"), F.array().cast("array<string>").alias("tags"))

    def _rows(self, ids: list[int] | None = None) -> DataFrame:
        """Each declaring row as numbers: (from_id, to_id, code, n), code being the type's place in TYPES and n what its locator is made of."""
        if ids is None:
            return _declaring(self.orders, self.lineitem, self.lineitem)
        keys = {kind: [i // 8 for i in ids if i % 8 == kind] for kind in (CUSTOMER, SUPPLIER, ORDER, PART)}
        near = lambda df, a, a_kind, b, b_kind: df.filter(F.col(a).isin(keys[a_kind]) | F.col(b).isin(keys[b_kind]))
        orders = near(self.orders, "o_custkey", CUSTOMER, "o_orderkey", ORDER)
        return _declaring(orders, near(self.lineitem, "l_orderkey", ORDER, "l_partkey", PART), near(self.lineitem, "l_partkey", PART, "l_suppkey", SUPPLIER))

    def declared(self, ids: list[int] | None = None) -> DataFrame:
        """Each declaring row: (from_id, to_id, type, source_id, locator), repeats included; of the rows at the given assets only, by filters on raw columns, which the scan can use."""
        return self._rows(ids).select("from_id", "to_id", type_of().alias("type"), source_of().alias("source_id"), locator_of().alias("locator"))

    def ownership(self) -> DataFrame:
        """(name, asset_id) by path prefix."""
        return owned(self.assets().filter("kind <> 'service'"), self.sources(), self.configs())

    def relationships(self, ids: list[int] | None = None) -> DataFrame:
        services = self.nation.select(F.col("n_name").alias("name"), key("n_nationkey", SERVICE).alias("from_id"))
        owns = self.ownership().filter("kind in ('customer', 'supplier')").join(services, "name").select("from_id", F.col("asset_id").alias("to_id"), F.lit(TYPES.index("owns_asset")).alias("code"))
        if ids is not None:
            owns = owns.filter(F.col("from_id").isin(ids) | F.col("to_id").isin(ids))
        found = self._rows(ids).select("from_id", "to_id", "code").unionByName(owns).dropDuplicates()  # numbers alone are moved; what follows from them comes after
        origin = F.when(F.col("code") == TYPES.index("owns_asset"), "source-derived").otherwise("declared")
        return found.select("from_id", "to_id", type_of().alias("type"), origin.alias("origin")).select(relation_id().alias("id"), "from_id", "to_id", "type", "origin")

    def evidence(self, ids: list[int] | None = None, type_: str | None = None) -> DataFrame:
        """Of assets, their source; of declared relationships, each distinct place. Only relationships at the given assets or of a type, if either is given."""
        null = F.lit(None).cast("long")
        assets = self.assets().select("source_id", F.col("id").alias("asset_id"), null.alias("relationship_id"), F.lit("row").alias("locator"))
        rows = self._rows(ids) if type_ is None else self._rows(ids).filter(F.col("code") == TYPES.index(type_))
        rows = rows.dropDuplicates().withColumns({"type": type_of(), "origin": F.lit("declared")})
        edges = rows.select(source_of().alias("source_id"), null.alias("asset_id"), relation_id().alias("relationship_id"), locator_of().alias("locator"))
        both = assets.unionByName(edges)
        return both.select(F.xxhash64("source_id", "asset_id", "relationship_id", "locator").alias("id"), *both.columns)

    def ledger(self) -> Ledger:
        sources = self.sources()
        return Ledger(sources, self.assets(), self.relationships(), self.evidence(), self.configs(), self.spark.createDataFrame([], DIAGNOSTICS), sources.select("path", "sha256"), {"last_build_at": "star"}, self.relationships, self.evidence)


def _declaring(orders: DataFrame, contained: DataFrame, supplied: DataFrame) -> DataFrame:
    row = lambda df, type_, start, end, n: df.select(start.alias("from_id"), end.alias("to_id"), F.lit(TYPES.index(type_)).alias("code"), F.col(n).cast("long").alias("n"))
    return (
        row(orders, "places", key("o_custkey", CUSTOMER), key("o_orderkey", ORDER), "o_orderkey")
        .unionByName(row(contained, "contains_part", key("l_orderkey", ORDER), key("l_partkey", PART), "l_linenumber"))
        .unionByName(row(supplied, "supplied_by", key("l_partkey", PART), key("l_suppkey", SUPPLIER), "l_linenumber"))
    )


def type_of() -> Column:
    return F.when(F.col("code") == 0, TYPES[0]).when(F.col("code") == 1, TYPES[1]).when(F.col("code") == 2, TYPES[2]).otherwise(TYPES[3])


def source_of() -> Column:
    """A customer's file places its orders; a part's and a supplier's say where they are used."""
    return F.when(F.col("code") == TYPES.index("places"), F.col("from_id")).otherwise(F.col("to_id"))


def locator_of() -> Column:
    return F.when(F.col("code") == TYPES.index("places"), text("orders.", F.col("n"))).otherwise(text("L", F.col("n")))


def relation_id() -> Column:
    return F.xxhash64("from_id", "to_id", "type", "origin")


#: The same ledger in DuckDB's SQL: views to put before a query.
SQL = """
sources AS (
  SELECT 8 * n_nationkey::BIGINT AS id, 'services/' || n_nationkey AS path, sha256(n_name) AS sha256 FROM nation
  UNION ALL SELECT 8 * c_custkey + 1, 'nation/' || c_nationkey || '/customer/' || c_custkey, sha256(c_name || '|' || c_mktsegment) FROM customer
  UNION ALL SELECT 8 * s_suppkey + 2, 'nation/' || s_nationkey || '/supplier/' || s_suppkey, sha256(s_name) FROM supplier
  UNION ALL SELECT 8 * p_partkey + 4, 'catalog/' || p_brand || '/' || p_partkey, sha256(p_name || '|' || p_type) FROM part),
assets AS (
  SELECT 8 * n_nationkey::BIGINT AS id, 8 * n_nationkey::BIGINT AS source_id, 'service' AS kind, n_name AS name, n_name AS canonical_name FROM nation
  UNION ALL SELECT 8 * c_custkey + 1, 8 * c_custkey + 1, 'customer', c_name, c_name FROM customer
  UNION ALL SELECT 8 * s_suppkey + 2, 8 * s_suppkey + 2, 'supplier', s_name, s_name FROM supplier
  UNION ALL SELECT 8 * o_orderkey + 3, 8 * o_custkey + 1, 'order', 'order ' || o_orderkey, 'order/' || o_orderkey FROM orders
  UNION ALL SELECT 8 * p_partkey + 4, 8 * p_partkey + 4, 'part', p_name, 'part/' || p_partkey FROM part),
configs AS (SELECT n_name AS name, r_name AS owner, 'nation/' || n_nationkey AS source_root, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
declared AS (
  SELECT 8 * o_custkey + 1 AS from_id, 8 * o_orderkey + 3 AS to_id, 'places' AS type, 8 * o_custkey + 1 AS source_id, 'orders.' || o_orderkey AS locator FROM orders
  UNION ALL SELECT 8 * l_orderkey + 3, 8 * l_partkey + 4, 'contains_part', 8 * l_partkey + 4, 'L' || l_linenumber FROM lineitem
  UNION ALL SELECT 8 * l_partkey + 4, 8 * l_suppkey + 2, 'supplied_by', 8 * l_suppkey + 2, 'L' || l_linenumber FROM lineitem),
owns AS (
  SELECT c.name, c.owner, 8 * c.n_nationkey::BIGINT AS from_id, a.id AS to_id, a.kind FROM assets a JOIN sources s ON s.id = a.source_id
  JOIN configs c ON s.path = c.source_root OR starts_with(s.path, c.source_root || '/') WHERE a.kind <> 'service'),
relationships AS (
  SELECT DISTINCT from_id, to_id, type, 'declared' AS origin FROM declared
  UNION ALL SELECT from_id, to_id, 'owns_asset', 'source-derived' FROM owns WHERE kind IN ('customer', 'supplier')),
link_evidence AS (SELECT DISTINCT from_id, to_id, type, d.source_id, s.path, locator FROM declared d JOIN sources s ON s.id = d.source_id)
"""
