"""Every query of the engine over the driver tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.functions.identity import fingerprint, stable_id
from factgraph.functions.names import normalize_name
from factgraph.operators import derive, integrity, links, neighborhood, ownership, paths, summary
from factgraph.plans import materialize, prefix, store
from factgraph.plans.model import Ledger
from factgraph.plans.star import SQL, Star, table
from factgraph.sources.queries import QUERIES as _EXTRACTION

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {name: f for name, (f, _) in _EXTRACTION.items()}
_ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _EXTRACTION.items()}

#: Customers and suppliers with the service that owns them, by the tables' own keys.
_HELD = "held AS (SELECT 8 * c_custkey + 1 AS id, 8 * c_nationkey::BIGINT AS service FROM customer UNION ALL SELECT 8 * s_suppkey + 2, 8 * s_nationkey::BIGINT FROM supplier)"

#: The assets that the single-asset queries ask about, by id: a customer, a supplier, a part, a service.
CUSTOMER_ASSET, SUPPLIER_ASSET, PART_ASSET, SERVICE_ASSET = 8 * 1 + 1, 8 * 1 + 2, 8 * 1 + 4, 8 * 1


def query(sql: str | None = None, star: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its name; sql reads the star ledger's views, or the plain tables if star is false."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = (f"WITH RECURSIVE {SQL}, {sql.strip()[5:]}" if sql.strip().startswith("WITH ") else f"WITH {SQL} {sql}") if star else sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the shortest path from a customer to a supplier, with the evidence of each step."""
    return path_customer_supplier(spark, sf_dir)


# -- summaries --------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT kind, count(*) AS n FROM assets GROUP BY kind")
def summary_asset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_kind(Star(spark, sf_dir).assets())


@query("SELECT count(*) FILTER (WHERE kind = 'service') AS service, count(*) FILTER (WHERE kind = 'customer') AS customer, count(*) FILTER (WHERE kind = 'table') AS \"table\" FROM assets")
def summary_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.counters(Star(spark, sf_dir).assets(), ("service", "customer", "table"))


@query("SELECT type, origin, count(*) AS n FROM relationships GROUP BY type, origin")
def summary_relationship_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_type(Star(spark, sf_dir).relationships())


# -- selection and links ----------------------------------------------------------------------------------------------------------------------------


@query("SELECT id, kind, name FROM assets WHERE kind = 'service' AND (name = 'NATION_3' OR canonical_name = 'NATION_3')")
def resolve_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.candidates(Star(spark, sf_dir).assets(), "service:NATION_3").select("id", "kind", "name")


@query("SELECT id, kind, name FROM assets WHERE name = 'red widget' OR canonical_name = 'red widget'")
def resolve_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.candidates(Star(spark, sf_dir).assets(), "red widget").select("id", "kind", "name")


_LINKS = """
SELECT CASE WHEN to_id = {0} THEN 'incoming' ELSE 'outgoing' END AS direction, r.type, r.origin, from_id, f.kind AS from_kind, f.name AS from_name, to_id, t.kind AS to_kind, t.name AS to_name{1}
FROM relationships r JOIN assets f ON f.id = from_id JOIN assets t ON t.id = to_id {2} WHERE from_id = {0} OR to_id = {0}"""


@query(_LINKS.format(PART_ASSET, ", e.evidence", "LEFT JOIN (SELECT from_id, to_id, type, string_agg(path || '@' || locator, ';' ORDER BY path, locator) AS evidence FROM link_evidence GROUP BY ALL) e USING (from_id, to_id, type)"))
def explain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.explain(Star(spark, sf_dir).ledger(), PART_ASSET)
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws("@", e["path"], e["locator"])), ";")
    return found.withColumn("evidence", shown).drop("relationship_id")


@query(f"WITH l AS ({_LINKS.format(SERVICE_ASSET, '', '')}) SELECT DISTINCT direction, type, if(direction = 'incoming', from_id, to_id) AS asset_id, if(direction = 'incoming', from_kind, to_kind) AS kind, if(direction = 'incoming', from_name, to_name) AS name FROM l")
def impact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.impact(Star(spark, sf_dir).ledger(), SERVICE_ASSET)


@query(
    f"""WITH l AS ({_LINKS.format(SERVICE_ASSET, '', '')}),
    d AS (SELECT DISTINCT direction, type, if(direction = 'incoming', from_id, to_id) AS asset_id, if(direction = 'incoming', from_kind, to_kind) AS kind, if(direction = 'incoming', from_name, to_name) AS name FROM l)
    SELECT asset_id, direction, row_number() OVER (ORDER BY direction = 'incoming', type, kind, name, asset_id) AS place FROM d"""
)
def impact_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of an asset that has very many, each with its place in the report's order."""
    found = links.impact(Star(spark, sf_dir).ledger(), SERVICE_ASSET).withColumn("incoming", F.col("direction") == "incoming")
    return prefix.numbered(found, ["incoming", "type", "kind", "name", "asset_id"], "place").select("asset_id", "direction", "place")


@query("SELECT from_id, to_id, type, string_agg(path || '@' || locator, ';' ORDER BY path, locator) AS evidence FROM link_evidence WHERE type = 'supplied_by' GROUP BY ALL")
def link_evidence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    edges = star.relationships().filter("type = 'supplied_by'")
    of = links.evidence_lists(star.evidence(type_="supplied_by"), star.sources())
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws("@", e["path"], e["locator"])), ";")
    return edges.join(of, edges["id"] == of["relationship_id"]).select("from_id", "to_id", "type", shown.alias("evidence"))


@query("SELECT from_id, to_id, type, row_number() OVER (PARTITION BY from_id ORDER BY type, origin, t.kind, t.name, to_id) AS place FROM relationships JOIN assets t ON t.id = to_id WHERE type <> 'owns_asset'")
def adjacency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    ends = star.assets().select(F.col("id").alias("to_id"), "kind", "name")
    order = Window.partitionBy("from_id").orderBy("type", "origin", "kind", "name", "to_id")
    return star.relationships().filter("type <> 'owns_asset'").join(ends, "to_id").select("from_id", "to_id", "type", F.row_number().over(order).cast("long").alias("place"))


# -- ownership --------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT name, owner, to_id AS asset_id, kind FROM owns")
def owns_asset_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Star(spark, sf_dir).ownership()


@query("SELECT to_id AS asset_id, name AS owner FROM owns WHERE kind IN ('customer', 'supplier')")
def owners_of_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    return ownership.owners(star.relationships(), star.assets())


@query("SELECT DISTINCT to_id AS asset_id, owner AS team FROM owns WHERE kind IN ('customer', 'supplier') UNION SELECT 8 * n_nationkey::BIGINT, owner FROM configs")
def teams_of_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    return ownership.teams(star.relationships(), star.assets(), star.configs())


@query("SELECT path, CASE WHEN count(c.name) = 1 THEN min(c.name) ELSE '' END AS service FROM (SELECT DISTINCT path FROM sources) s LEFT JOIN configs c ON path = source_root OR starts_with(path, source_root || '/') GROUP BY path")
def unique_service_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    return ownership.unique_service(star.sources(), star.configs())


@query(
    """WITH t AS (SELECT s.s_suppkey, 'nation/' || s.s_nationkey AS root, 'stock_' || s.s_suppkey % 3 AS target FROM supplier s),
    r AS (SELECT 'nation/' || c_nationkey || '/customer/' || c_custkey AS path, 'nation/' || c_nationkey AS root, 'stock_' || c_custkey % 3 AS target, c_nationkey FROM customer),
    m AS (SELECT r.path, r.target, r.c_nationkey, count(t.s_suppkey) AS matches, min(t.s_suppkey) AS k FROM r LEFT JOIN t ON r.root = t.root AND r.target = t.target GROUP BY ALL)
    SELECT path, target, 'NATION_' || c_nationkey AS service, matches, CASE WHEN matches = 1 THEN 8 * k + 5 ELSE -1 END AS asset_id,
    CASE matches WHEN 0 THEN 'No exact scanned DDL table matches inside the query''s service.' WHEN 1 THEN '' ELSE 'Multiple scanned DDL tables match inside the query''s service; schema or DDL scope is ambiguous.' END AS reason FROM m"""
)
def table_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' files ask for one of three tables; each supplier's file declares one."""
    star = Star(spark, sf_dir)
    name = lambda c: F.concat(F.lit("stock_"), (F.col(c) % 3).cast("string"))
    tables = star.supplier.select((F.col("s_suppkey") * 8 + 5).alias("id"), (F.col("s_suppkey") * 8 + 2).alias("source_id"), F.lit("table").alias("kind"), name("s_suppkey").alias("canonical_name"))
    asked = star.customer.select(F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string"), F.lit("/customer/"), F.col("c_custkey").cast("string")).alias("path"), name("c_custkey").alias("target"))
    evidence = tables.select(F.col("id").alias("asset_id"), F.lit("CREATE TABLE").alias("locator"))
    found = ownership.resolve_tables(asked, tables, star.sources(), evidence, star.configs())
    return found.withColumn("asset_id", F.coalesce("asset_id", F.lit(-1).cast("long")))


# -- derived links ----------------------------------------------------------------------------------------------------------------------------------


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names as schemas, and as tables in another spelling."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg((F.min("p_partkey") * 8).alias("k"))
    schemas = names.select((F.col("k") + 5).alias("id"), F.col("k").alias("source_id"), F.lit("schema").alias("kind"), F.col("p_name").alias("name"))
    tables = names.select((F.col("k") + 6).alias("id"), (F.col("k") + 1).alias("source_id"), F.lit("table").alias("kind"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"))
    return schemas.unionByName(tables)


_NAMED = "n AS (SELECT p_name, 8 * min(p_partkey) AS k, regexp_replace(lower(p_name), '[^\\p{L}\\p{Nd}]', '', 'g') AS key FROM part GROUP BY p_name)"


@query(f"WITH {_NAMED} SELECT s.k + 5 AS schema_id, t.k + 6 AS table_id, s.key AS key FROM n s JOIN n t ON s.key = t.key", star=False)
def build_inferred_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.name_links(_named(spark, sf_dir)).select("schema_id", "table_id", "key")


@query(f"WITH {_NAMED}, m AS (SELECT s.k + 5 AS schema_id, t.k + 6 AS table_id, s.k AS a, t.k + 1 AS b, s.key AS key FROM n s JOIN n t ON s.key = t.key) SELECT schema_id, table_id, a AS source_id, 'normalized-name:' || key AS locator FROM m UNION SELECT schema_id, table_id, b, 'normalized-name:' || key FROM m", star=False)
def build_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger.empty(spark)
    ledger.assets = _named(spark, sf_dir)
    built = derive.build(ledger, "now")
    r = built.relationships.select(F.col("id").alias("relationship_id"), F.col("from_id").alias("schema_id"), F.col("to_id").alias("table_id"))
    return built.evidence.join(r, "relationship_id").select("schema_id", "table_id", "source_id", "locator")


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' ΟΔΟΣ-' || p_type || '_9'), '[^\\p{L}\\p{Nd}]', '', 'g') AS key FROM part", star=False)
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", normalize_name(F.concat("p_name", F.lit(" ΟΔΟΣ-"), "p_type", F.lit("_9"))).alias("key"))


# -- sets -------------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT 8 * l_partkey + 4 AS from_id, 8 * l_suppkey + 2 AS to_id, 'supplied_by' AS type FROM lineitem", star=False)
def edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Star(spark, sf_dir).relationships().filter("type = 'supplied_by'").select("from_id", "to_id", "type")


@query("SELECT DISTINCT from_id, to_id, type, source_id, locator FROM declared WHERE type = 'contains_part'")
def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Star(spark, sf_dir).declared().filter("type = 'contains_part'").select("from_id", "to_id", "type", "source_id", "locator").dropDuplicates()


# -- graph ------------------------------------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH p AS (
      SELECT a.from_id AS x0, a.to_id AS x1, b.to_id AS x2, c.to_id AS x3, o.name AS n1, q.name AS n2, z.name AS n3
      FROM relationships a JOIN relationships b ON b.from_id = a.to_id AND b.type = 'contains_part' JOIN relationships c ON c.from_id = b.to_id AND c.type = 'supplied_by'
      JOIN assets o ON o.id = a.to_id JOIN assets q ON q.id = b.to_id JOIN assets z ON z.id = c.to_id
      WHERE a.type = 'places' AND a.from_id = {CUSTOMER_ASSET} AND c.to_id = {SUPPLIER_ASSET} ORDER BY o.name, x1, q.name, x2, x3 LIMIT 1),
    s AS (SELECT 1::BIGINT AS step, x0 AS from_id, x1 AS to_id, 'places' AS type, 'order' AS kind, n1 AS name FROM p
      UNION ALL SELECT 2, x1, x2, 'contains_part', 'part', n2 FROM p UNION ALL SELECT 3, x2, x3, 'supplied_by', 'supplier', n3 FROM p)
    SELECT s.step, s.from_id, s.to_id, s.type, s.kind, s.name, string_agg(path || '@' || locator, ';' ORDER BY path, locator) AS evidence FROM s JOIN link_evidence USING (from_id, to_id, type) GROUP BY ALL"""
)
def path_customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    # Repeats make no other path, so they are not looked for; ties go to the smaller end.
    ids = star.declared().select(F.col("to_id").alias("id"), "from_id", "to_id", "type", F.lit("declared").alias("origin"))
    schema = "step long, from_id long, to_id long, type string, kind string, name string, evidence string"
    try:
        found = paths.shortest_path(ids, star.assets(), CUSTOMER_ASSET, SUPPLIER_ASSET)
    except LookupError:
        return spark.createDataFrame([], schema)
    ends = sorted({x for r in found.select("from_id", "to_id").collect() for x in r})  # one row a step
    near = star.declared(ends).join(found.select("from_id", "to_id", "type"), ["from_id", "to_id", "type"], "left_semi").dropDuplicates()
    at = near.join(star.sources().select(F.col("id").alias("source_id"), "path"), "source_id")
    lists = at.groupBy("from_id", "to_id", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "locator"))), lambda e: F.concat_ws("@", e["path"], e["locator"])), ";").alias("evidence"))
    return found.join(lists, ["from_id", "to_id", "type"]).select("step", "from_id", "to_id", "type", "kind", "name", "evidence")


def _levels() -> str:
    """The bounded neighbourhood, a level at a time: candidates by their first parent, then kind, canonical name and path, as far as 32 go."""
    parts = [
        "both_ways AS (SELECT from_id AS id, to_id AS next FROM relationships WHERE type <> 'owns_asset' UNION SELECT to_id, from_id FROM relationships WHERE type <> 'owns_asset')",
        f"l0 AS (SELECT {CUSTOMER_ASSET}::BIGINT AS id, 0 AS depth, 1::BIGINT AS place)",
    ]
    seen = "SELECT * FROM l0"
    for d in range(1, 5):
        parts += [
            f"s{d} AS ({seen})",
            f"c{d} AS (SELECT next, min(place) AS parent FROM l{d - 1} JOIN both_ways USING (id) WHERE next NOT IN (SELECT id FROM s{d}) GROUP BY next)",
            f"""l{d} AS (SELECT * FROM (SELECT next AS id, {d} AS depth, (SELECT count(*) FROM s{d}) + row_number() OVER (ORDER BY parent, a.kind, a.canonical_name, s.path) AS place
                FROM c{d} JOIN assets a ON a.id = next JOIN sources s ON s.id = a.source_id) WHERE place <= 32)""",
        ]
        seen += f" UNION ALL SELECT * FROM l{d}"
    return ", ".join([*parts, f"admitted AS ({seen})"])


@query(f"WITH {_levels()} SELECT id AS asset_id, depth, place::INTEGER AS place, kind, name FROM admitted JOIN assets USING (id)")
def neighborhood_pack_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Star(spark, sf_dir).ledger()
    found = neighborhood.pack_assets(ledger, neighborhood.admit(ledger, CUSTOMER_ASSET))
    return found.select("asset_id", "depth", (F.col("place") + 1).alias("place"), "kind", "name")


@query(
    f"""WITH {_levels()}, st AS (SELECT a.id, 'asset:' || sha256('["' || a.kind || '","' || s.path || '","' || a.canonical_name || '"]') AS stable FROM admitted JOIN assets a USING (id) JOIN sources s ON s.id = a.source_id)
    SELECT 'relation:' || sha256('["' || f.stable || '","' || t.stable || '","' || type || '","' || origin || '"]') AS stable_id, f.stable AS from_stable, t.stable AS to_stable, type, origin
    FROM relationships JOIN st f ON f.id = from_id JOIN st t ON t.id = to_id WHERE type <> 'owns_asset' ORDER BY stable_id LIMIT 64"""
)
def neighborhood_pack_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Star(spark, sf_dir).ledger()
    assets = neighborhood.pack_assets(ledger, neighborhood.admit(ledger, CUSTOMER_ASSET))
    return neighborhood.pack_relationships(ledger, assets)[0].drop("relationship_id")


@query(
    f"""WITH {_levels()}, st AS (SELECT DISTINCT s.path FROM admitted JOIN assets a USING (id) JOIN sources s ON s.id = a.source_id),
    d AS (SELECT path, 'L' || n AS locator, 'seeded' AS code, 'gap ' || n AS message FROM sources, (VALUES (1), (2), (3)) v(n)),
    o AS (SELECT * FROM d JOIN st USING (path) ORDER BY path, locator, code, message LIMIT 62)
    SELECT path AS source, locator, code, message FROM o"""
)
def neighborhood_pack_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps of a pack, without the closing ones: three are seeded in every source, and 62 at most stay, by path."""
    ledger = Star(spark, sf_dir).ledger()
    ledger.diagnostics = ledger.sources.select(F.lit("seeded").alias("code"), F.explode(F.array(*(F.lit(f"gap {n}") for n in (1, 2, 3)))).alias("message"), "path")
    ledger.diagnostics = ledger.diagnostics.withColumn("locator", F.concat(F.lit("L"), F.substring("message", -1, 1)))
    assets = neighborhood.pack_assets(ledger, neighborhood.admit(ledger, CUSTOMER_ASSET))
    places = assets.select(F.col("asset_id").alias("id")).join(ledger.assets.select("id", "source_id"), "id").join(ledger.sources.select(F.col("id").alias("source_id"), "path"), "source_id")
    return neighborhood.gaps_at(ledger, [r.path for r in places.select("path").distinct().collect()])[0].select(F.col("path").alias("source"), "locator", "code", "message")


_PACK = f"""{_HELD}, {_levels()}, st AS (SELECT a.id, s.path, s.sha256, 'asset:' || sha256('["' || a.kind || '","' || s.path || '","' || a.canonical_name || '"]') AS stable FROM admitted JOIN assets a USING (id) JOIN sources s ON s.id = a.source_id),
    inside AS (SELECT from_id, to_id, type, 'relation:' || sha256('["' || f.stable || '","' || t.stable || '","' || type || '","' || origin || '"]') AS stable
      FROM relationships JOIN st f ON f.id = from_id JOIN st t ON t.id = to_id WHERE type <> 'owns_asset' ORDER BY stable LIMIT 64),
    place AS (
      SELECT stable AS of, path, sha256, 'row' AS locator FROM st
      UNION SELECT i.stable, e.path, s.sha256, locator FROM inside i JOIN link_evidence e USING (from_id, to_id, type) JOIN sources s ON s.id = e.source_id
      UNION SELECT st.stable, s.path, s.sha256, 'row' FROM st JOIN held USING (id) JOIN sources s ON s.id = held.service)"""


@query(f"""WITH {_PACK} SELECT of AS target, 'evidence:' || sha256('["' || path || '","' || sha256 || '","' || locator || '"]') AS evidence_id, path AS source, locator FROM place""")
def neighborhood_pack_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset and relationship of a pack with each place of its evidence; an asset's is also that of its services."""
    found = neighborhood.pack(Star(spark, sf_dir).ledger(), CUSTOMER_ASSET)
    at = {e["id"]: e for e in found["evidence"]}  # PACK_EVIDENCE at most
    rows = [(x["id"], i, at[i]["source"], at[i]["locator"]) for x in found["assets"] + found["relationships"] for i in x["evidence_ids"]]
    return spark.createDataFrame(rows, "target string, evidence_id string, source string, locator string")


@query(f"WITH {_PACK} SELECT stable AS asset, c.name AS service, c.owner AS team FROM st JOIN held USING (id) JOIN configs c ON 8 * c.n_nationkey = held.service")
def neighborhood_pack_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The services and teams of a pack's assets."""
    found = neighborhood.pack(Star(spark, sf_dir).ledger(), CUSTOMER_ASSET)
    return spark.createDataFrame([(a["id"], o["name"], o["team"]) for a in found["assets"] for o in a["owners"]], "asset string, service string, team string")


_DENSE = """a AS (SELECT from_id AS id FROM relationships WHERE type = 'supplied_by' AND to_id <= 82 GROUP BY from_id ORDER BY count(*) DESC, from_id LIMIT 22),
    st AS (SELECT x.id, 'asset:' || sha256('["' || x.kind || '","' || s.path || '","' || x.canonical_name || '"]') AS stable FROM assets x JOIN sources s ON s.id = x.source_id WHERE x.id IN (SELECT id FROM a) OR x.kind = 'supplier' AND x.id <= 82)"""


@query(
    f"""WITH {_DENSE}, r AS (SELECT 'relation:' || sha256('["' || f.stable || '","' || t.stable || '","' || type || '","' || origin || '"]') AS stable_id, f.stable AS from_stable, t.stable AS to_stable, type
      FROM relationships JOIN st f ON f.id = from_id JOIN st t ON t.id = to_id WHERE type <> 'owns_asset')
    SELECT *, row_number() OVER (ORDER BY stable_id) AS place, (SELECT count(*) FROM r) > 64 AS more FROM r ORDER BY stable_id LIMIT 64"""
)
def pack_relationships_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the links between the first suppliers and the 22 parts that most of them supply, the 64 that a pack takes, and whether there are more."""
    ledger = Star(spark, sf_dir).ledger()
    parts = ledger.relationships.filter("type = 'supplied_by' and to_id <= 82").groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(22)
    ids = [r.id for r in parts.collect()] + [8 * k + 2 for k in range(11)]
    assets = neighborhood.pack_assets(ledger, neighborhood.Admitted(dict.fromkeys(ids, 0), False))
    first, more = neighborhood.pack_relationships(ledger, assets)
    return prefix.numbered(first.drop("relationship_id", "origin"), ["stable_id"], "place").withColumn("more", F.lit(more))


# -- integrity --------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT id, kind FROM assets WHERE id % 97 = 0")
def verify_assets_without_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    ledger = Ledger.empty(spark)
    ledger.assets, ledger.evidence = star.assets(), star.evidence().filter("asset_id % 97 <> 0")  # seeded: these have lost theirs
    return integrity.assets_without_evidence(ledger).select("id", "kind")


@query("SELECT from_id, to_id, type FROM relationships WHERE type <> 'owns_asset' AND (from_id + to_id) % 97 = 0")
def verify_edges_without_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    ledger = Ledger.empty(spark)
    ledger.relationships = star.relationships().filter("type <> 'owns_asset'")
    whole = ledger.relationships.filter("(from_id + to_id) % 97 <> 0").select(F.col("id").alias("relationship_id"))  # seeded: the others have lost theirs
    ledger.evidence = star.evidence().join(whole, "relationship_id", "left_semi")
    return integrity.relationships_without_evidence(ledger).select("from_id", "to_id", "type")


def _violations(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table's rows of all six checks, with seeded losses of sources, assets and relationships, counted by value; a lost relationship is shown by its ends, since its id is a hash."""
    star = Star(spark, sf_dir)
    ledger = Ledger.empty(spark)
    ledger.sources, ledger.assets = star.sources().filter("id % 97 <> 1"), star.assets().filter("id % 89 <> 4")
    ledger.evidence = star.evidence()
    ledger.relationships = star.relationships().filter("(from_id + to_id) % 83 <> 2")
    ends = star.relationships().select(F.col("id").alias("value"), F.lit("relationship_id").alias("column"), (F.col("from_id") * 1000003 + F.col("to_id")).alias("ends"))
    found = integrity.foreign_key_violations(ledger, name)
    found = found.join(ends, ["value", "column"], "left") if name == "evidence" else found.withColumn("ends", F.lit(None).cast("long"))
    return found.groupBy("column", F.coalesce("ends", "value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'source_id' AS \"column\", source_id AS \"value\", count(*) AS n FROM assets WHERE id % 89 <> 4 AND source_id % 97 = 1 GROUP BY source_id")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, "assets")


@query("WITH r AS (SELECT unnest([{'c': 'from_id', 'v': from_id}, {'c': 'to_id', 'v': to_id}]) AS x FROM relationships WHERE (from_id + to_id) % 83 <> 2) SELECT x.c AS \"column\", x.v AS \"value\", count(*) AS n FROM r WHERE x.v % 89 = 4 GROUP BY ALL")
def fk_violations_of_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, "relationships")


@query(
    """WITH e AS MATERIALIZED (SELECT source_id, id AS asset_id, NULL::BIGINT AS f, NULL::BIGINT AS t FROM assets
      UNION ALL SELECT source_id, NULL, from_id, to_id FROM (SELECT DISTINCT source_id, from_id, to_id, type, locator FROM declared)),
    x AS (SELECT unnest([{'c': 'source_id', 'v': if(source_id % 97 = 1, source_id, NULL)}, {'c': 'asset_id', 'v': if(asset_id % 89 = 4, asset_id, NULL)},
      {'c': 'relationship_id', 'v': if((f + t) % 83 = 2, f * 1000003 + t, NULL)}]) AS x FROM e)
    SELECT x.c AS "column", x.v AS "value", count(*) AS n FROM x WHERE x.v IS NOT NULL GROUP BY ALL"""
)
def fk_violations_of_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, "evidence")


@query(
    f"""WITH {_HELD}, e AS MATERIALIZED (SELECT source_id, id AS asset_id, NULL::BIGINT AS f, NULL::BIGINT AS t, true AS asset FROM assets
      UNION ALL SELECT source_id, NULL, from_id, to_id, false FROM (SELECT DISTINCT source_id, from_id, to_id, type, locator FROM declared)),
    a AS MATERIALIZED (SELECT id, source_id FROM assets WHERE id % 89 <> 4),
    r AS MATERIALIZED (SELECT from_id, to_id FROM (SELECT DISTINCT from_id, to_id FROM declared UNION ALL SELECT service, id FROM held) WHERE (from_id + to_id) % 83 <> 2),
    n AS (SELECT (SELECT count(*) FROM a WHERE source_id % 97 = 1) + (SELECT count(*) FILTER (WHERE from_id % 89 = 4) + count(*) FILTER (WHERE to_id % 89 = 4) FROM r)
        + (SELECT count(*) FILTER (WHERE source_id % 97 = 1) + count(*) FILTER (WHERE asset AND asset_id % 89 = 4) + count(*) FILTER (WHERE NOT asset AND (f + t) % 83 = 2) FROM e) AS keys,
      (SELECT count(*) FROM held WHERE (service + id) % 83 <> 2) AS edges, (SELECT count(*) FROM e WHERE source_id % 97 = 1) AS orphans)
    SELECT 'foreign-key violations' AS "check", keys AS failures FROM n UNION ALL SELECT 'assets without evidence', 0 FROM n
    UNION ALL SELECT 'relationships without evidence', edges FROM n UNION ALL SELECT 'orphaned evidence', orphans FROM n"""
)
def verify_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records fail each structural check of a ledger with seeded losses; derived ownership has no evidence in the star ledger."""
    star = Star(spark, sf_dir)
    ledger = Ledger.empty(spark)
    ledger.sources, ledger.assets, ledger.evidence = star.sources().filter("id % 97 <> 1"), star.assets().filter("id % 89 <> 4"), star.evidence()
    ledger.relationships = star.relationships().filter("(from_id + to_id) % 83 <> 2")
    return integrity.verdicts(ledger)


@query(
    f"""WITH {_HELD}, d AS MATERIALIZED (SELECT DISTINCT from_id, to_id, source_id, locator FROM declared)
    SELECT 'asset' AS what, a.id AS first, s.id AS second, s.path || ' ' || s.sha256 AS at FROM (SELECT id, source_id FROM assets) a JOIN sources s ON s.id = a.source_id
    UNION ALL SELECT DISTINCT 'relationship', from_id, to_id, '' FROM d UNION ALL SELECT 'relationship', service, id, '' FROM held
    UNION ALL SELECT 'evidence', source_id, id, 'row' FROM assets UNION ALL SELECT 'evidence', source_id, from_id, locator FROM d"""
)
def generation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger committed as a generation and loaded again: every asset with its source, every relationship and every place of evidence."""
    folder = materialize.folder(spark.range(0), "generation")
    store.save(Star(spark, sf_dir).ledger(), folder)
    found = store.load(spark, folder)
    row = lambda what, first, second, at: [F.lit(what).alias("what"), F.col(first).alias("first"), F.col(second).alias("second"), at.alias("at")]
    sources = found.sources.select(F.col("id").alias("source_id"), F.concat_ws(" ", "path", "sha256").alias("at"))
    ends = found.relationships.select(F.col("id").alias("relationship_id"), "from_id")
    return (
        found.assets.join(sources, "source_id").select(*row("asset", "id", "source_id", F.col("at")))
        .unionByName(found.relationships.select(*row("relationship", "from_id", "to_id", F.lit(""))))
        .unionByName(found.evidence.filter("asset_id is not null").select(*row("evidence", "source_id", "asset_id", F.col("locator"))))
        .unionByName(found.evidence.join(ends, "relationship_id").select(*row("evidence", "source_id", "from_id", F.col("locator"))))
    )


@query("SELECT source_id, count(*) AS n FROM (SELECT source_id FROM assets UNION ALL SELECT source_id FROM (SELECT DISTINCT source_id, from_id, to_id, type, locator FROM declared)) WHERE source_id % 97 = 1 GROUP BY source_id")
def verify_orphaned_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    ledger = Ledger.empty(spark)
    ledger.evidence, ledger.sources = star.evidence(), star.sources().filter("id % 97 <> 1")  # seeded: these sources are gone
    return integrity.orphaned_evidence(ledger).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id AS asset_id, source_id FROM assets WHERE id % 101 = 3 UNION ALL SELECT -1, source_id FROM assets WHERE id % 103 = 5 AND id % 101 <> 3")
def verify_evidence_of_one_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded: evidence that stands for an asset and a relationship, or for neither."""
    ledger = Ledger.empty(spark)
    e = Star(spark, sf_dir).evidence().filter("asset_id is not null")
    ledger.evidence = e.withColumn("relationship_id", F.when(F.col("asset_id") % 101 == 3, 1)).withColumn("asset_id", F.when((F.col("asset_id") % 103 != 5) | (F.col("asset_id") % 101 == 3), F.col("asset_id")))
    return integrity.one_target(ledger).select(F.coalesce("asset_id", F.lit(-1).cast("long")).alias("asset_id"), "source_id")


@query("SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 13 = 0 THEN 'removed' WHEN doc_id % 17 = 0 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 13 = 0 OR doc_id % 10 = 0 OR doc_id % 17 = 0", star=False)
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path, digest = F.col("doc_id").cast("string").alias("path"), fingerprint(F.col("text"))
    then = docs.filter("doc_id % 17 <> 0 or doc_id % 13 = 0").select(path, digest.alias("sha256"))
    now = docs.filter("doc_id % 13 <> 0").select(path, F.when(F.col("doc_id") % 10 == 0, F.concat(digest, F.lit("x"))).otherwise(digest).alias("sha256"))
    return integrity.inventory_diff(then, now)


@query(
    """WITH d AS (SELECT source || '/' || lang || '/' || doc_id AS path, source, doc_id, text FROM documents)
    SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'removed' WHEN doc_id % 17 = 0 THEN 'added' ELSE 'changed' END AS change FROM d WHERE source = 'src3' AND (doc_id % 13 = 0 OR doc_id % 10 = 0 OR doc_id % 17 = 0)""", star=False
)
def inventory_diff_of_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in folders by source and language, of which one source has changed; the other folders' files are not joined."""
    docs = table(spark, sf_dir, "documents")
    path, digest, here = F.concat_ws("/", "source", "lang", "doc_id").alias("path"), fingerprint(F.col("text")), F.col("source") == "src3"
    then = docs.filter(~here | (F.col("doc_id") % 17 != 0) | (F.col("doc_id") % 13 == 0)).select(path, digest.alias("sha256"))
    now = docs.filter(~here | (F.col("doc_id") % 13 != 0)).select(path, F.when(here & (F.col("doc_id") % 10 == 0), F.concat(digest, F.lit("x"))).otherwise(digest).alias("sha256"))
    return integrity.inventory_diff(then, now)


@query("SELECT id, row_number() OVER (ORDER BY kind, canonical_name, id) AS place FROM assets")
def numbered_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assets in one order, numbered without a gap and without a task that sees them all."""
    return prefix.numbered(Star(spark, sf_dir).assets().select("kind", "canonical_name", "id"), ["kind", "canonical_name", "id"], "place").select("id", "place")


@query(
    """SELECT doc_id, (sum(steps) OVER w)::BIGINT AS all_steps, (sum(bytes) OVER w)::BIGINT AS all_bytes, (sum(steps) OVER w <= 20000 AND sum(bytes) OVER w <= 1000000) AS within
    FROM (SELECT doc_id, source, 1 + len(text) - len(replace(text, chr(10), '')) AS steps, strlen(text) AS bytes FROM documents) WINDOW w AS (ORDER BY source, doc_id)""", star=False
)
def budget_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents up to each cost together, in steps and bytes, and whether a budget still holds for it."""
    docs = table(spark, sf_dir, "documents")
    costs = docs.select("doc_id", "source", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("steps"), F.octet_length("text").alias("bytes"))
    spent = prefix.running(costs, ["source", "doc_id"], {"steps": "all_steps", "bytes": "all_bytes"})
    return spent.select("doc_id", "all_steps", "all_bytes", ((F.col("all_steps") <= 20_000) & (F.col("all_bytes") <= 1_000_000)).alias("within"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents", star=False)
def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint(F.col("text")).alias("sha256"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1", star=False)
def duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_fingerprints(spark, sf_dir).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


# -- references, ids, attributes --------------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages", star=False)
def page_reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")).distinct()


@query("WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) SELECT target, count(DISTINCT page_id) AS pages FROM r WHERE target NOT IN (SELECT url FROM pages) GROUP BY target", star=False)
def page_reference_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = page_reference_edges(spark, sf_dir)
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("target"))
    return edges.join(urls, "target", "left_anti").groupBy("target").agg(F.count(F.lit(1)).alias("pages"))


@query("""SELECT n_nationkey, 'asset:' || sha256('["service","a\\u003cb\\u0026c","' || n_name || '"]') AS stable_id FROM nation""", star=False)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", stable_id("asset", F.lit("service"), F.lit("a<b&c"), F.col("n_name")).alias("stable_id"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, array_to_string(list_filter(json_keys(props), lambda n: n IN ('k', 'domain')), ',') AS names FROM events", star=False)
def attribute_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = F.from_json("props", "map<string,string>", {"mode": "FAILFAST"})
    kept = neighborhood.allowed_attributes(F.map_concat(attributes, F.create_map(F.lit("hidden"), F.lit("x"))), ("k", "domain"))
    return table(spark, sf_dir, "events").select("event_id", kept["k"].cast("long").alias("k"), F.array_join(F.map_keys(kept), ",").alias("names"))
