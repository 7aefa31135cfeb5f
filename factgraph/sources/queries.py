"""Extraction queries over the driver tables: documents are made of rows, the extractors read them, and SQL states the facts from the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import gocalls
from factgraph.operators.ownership import MANY_TABLES, NO_SERVICE, NO_TABLE
from factgraph.plans import materialize
from factgraph.plans.normalize import ledger_of
from factgraph.plans.star import table
from factgraph.sources import scan, sqlref
from factgraph.sources.manifest import Manifest, Service

REFERENCE = "schema string, table string, access string, operation string, error string"


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def contents(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """A file for each row. The rows of a small table lie in one part of it: they are dealt out before they grow to files, whose reading costs more than their move."""
    return dealt(df).select(path.alias("path"), content.cast("binary").alias("content"))


def dealt(df: DataFrame) -> DataFrame:
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def sql_references(texts: DataFrame) -> DataFrame:
    """(key, schema, table, access, operation, error) of (key, sql): the table that each statement reads or writes, or why none is recognized."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, sql in zip(batch["key"], batch["sql"], strict=True):
                try:
                    r = sqlref.recognize(sql or "")
                    rows.append((k, r.schema, r.table, r.access, r.operation, ""))
                except sqlref.NotRecognized:
                    rows.append((k, "", "", "", "", "go_unsupported_sql"))
            yield pd.DataFrame(rows, columns=["key", "schema", "table", "access", "operation", "error"])

    return dealt(texts.select("key", "sql")).mapInPandas(run, f"key long, {REFERENCE}")


def ddl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per part: a real table, between ones in a string, a comment and a body."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    content = text("-- CREATE TABLE no_", key, " (x int);\nSELECT 'CREATE TABLE no (x int);';\nCREATE TABLE IF NOT EXISTS Shop.\"part_", key, "\" (id INT /* ; */);\nDO $x$ CREATE TABLE no (x int); $x$;")
    facts = scan.facts_of(contents(part, text("sql/", key, ".sql"), content)).filter("fact = 'asset'")
    return facts.select("path", "kind", "name", "canonical", "locator")


DDL_SQL = """SELECT 'sql/' || p_partkey || '.sql' AS path, 'table' AS kind, 'part_' || p_partkey AS name, 'Shop.part_' || p_partkey AS canonical, 'CREATE TABLE Shop."part_' || p_partkey || '"' AS locator FROM part"""


def _edges(facts: DataFrame) -> DataFrame:
    a = facts.filter("fact = 'asset'").select("path", F.lit("asset").alias("fact"), "kind", F.col("canonical").alias("subject"), F.col("name").alias("object"), "locator")
    e = facts.filter("fact = 'edge'").select("path", F.lit("edge").alias("fact"), F.col("type").alias("kind"), F.col("from_canonical").alias("subject"), F.col("to_canonical").alias("object"), "locator")
    return a.unionByName(e)


def openapi_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per supplier with two operations, one of which refers to a schema and to one that is missing."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    content = text(
        '{"openapi": "3.0.3", "info": {"title": "', F.col("s_name"), '"}, "components": {"schemas": {"S', key, '": {}}}, "paths": {"/s/', key,
        '": {"post": {"operationId": "make', key, '"}, "get": {"responses": {"200": {"a": [{"$ref": "#/components/schemas/S', key, '"}, {"$ref": "#/components/schemas/Gone"}]}}}}}}',
    )
    return _edges(scan.facts_of(contents(s, text("api/", key, ".json"), content)))


OPENAPI_SQL = """WITH s AS (SELECT s_suppkey AS k, s_name, 'api/' || s_suppkey || '.json' AS path FROM supplier)
SELECT path, 'asset' AS fact, 'api' AS kind, s_name AS subject, s_name AS object, 'info' AS locator FROM s
UNION ALL SELECT path, 'asset', 'schema', 'S' || k, 'S' || k, 'components.schemas.S' || k FROM s
UNION ALL SELECT path, 'asset', 'operation', 'GET /s/' || k, 'GET /s/' || k, 'paths./s/' || k || '.get' FROM s
UNION ALL SELECT path, 'asset', 'operation', 'POST /s/' || k, 'make' || k, 'paths./s/' || k || '.post' FROM s
UNION ALL SELECT path, 'edge', 'contains_operation', s_name, 'GET /s/' || k, 'paths./s/' || k || '.get' FROM s
UNION ALL SELECT path, 'edge', 'contains_operation', s_name, 'POST /s/' || k, 'paths./s/' || k || '.post' FROM s
UNION ALL SELECT path, 'edge', 'references_schema', 'GET /s/' || k, 'S' || k, 'paths./s/' || k || '.get' FROM s"""


def asyncapi_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer with a channel that publishes a named message."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    content = text('{"asyncapi": "2.6.0", "channels": {"c.', key, '": {"publish": {"message": {"name": "M', key, '", "payload": {"$ref": "#/components/schemas/P"}}}}}, "components": {"schemas": {"P": {}}}}')
    return _edges(scan.facts_of(contents(c, text("events/", key, ".json"), content)))


ASYNCAPI_SQL = """WITH c AS (SELECT c_custkey AS k, 'events/' || c_custkey || '.json' AS path, 'channels.c.' || c_custkey AS loc FROM customer)
SELECT path, 'asset' AS fact, 'asyncapi' AS kind, 'AsyncAPI document' AS subject, 'AsyncAPI document' AS object, 'info' AS locator FROM c
UNION ALL SELECT path, 'asset', 'schema', 'P', 'P', 'components.schemas.P' FROM c
UNION ALL SELECT path, 'asset', 'channel', 'c.' || k, 'c.' || k, loc FROM c
UNION ALL SELECT path, 'asset', 'message', 'c.' || k || ' publish', 'M' || k, loc || '.publish.message' FROM c
UNION ALL SELECT path, 'edge', 'contains_channel', 'AsyncAPI document', 'c.' || k, loc FROM c
UNION ALL SELECT path, 'edge', 'contains_message', 'c.' || k, 'c.' || k || ' publish', loc || '.publish.message' FROM c
UNION ALL SELECT path, 'edge', 'references_schema', 'c.' || k || ' publish', 'P', loc || '.publish.message' FROM c"""


def go_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package per supplier: a route with its handler, a query of a constant made of two, a call, and a receiver that nothing proves."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    content = text(
        'package p\n\nimport (\n\t"database/sql"\n\tweb "net/http"\n)\n\nconst head = "SELECT id "\nconst all = head + "FROM t', key,
        '"\n\nfunc Serve(w web.ResponseWriter, r *web.Request) {}\n\nfunc Run(db *sql.DB, m *web.ServeMux) {\n\tm.HandleFunc("GET /s/', key,
        '", Serve)\n\tdb.Query(all)\n\tServe(nil, nil)\n\tlost.Exec("x")\n}\n',
    )
    facts, tables = gocalls.resolved(materialize.written(scan.facts_of(contents(s, text("svc/", key, "/a.go"), content)), "facts"))
    shown = lambda c: F.regexp_replace(F.col(c), "#[0-9]+$", "")
    a = facts.filter("fact = 'asset' and kind in ('route', 'query')").select("path", "fact", "kind", shown("canonical").alias("subject"), "name", "locator")
    e = facts.filter("fact = 'edge' and type <> 'contains'").select("path", "fact", F.col("type").alias("kind"), shown("from_canonical").alias("subject"), shown("to_canonical").alias("name"), "locator")
    g = facts.filter("fact in ('gap', 'support')").select("path", "fact", "kind", F.coalesce(shown("canonical"), F.lit("")).alias("subject"), F.lit("").alias("name"), "locator")
    t = tables.select("path", F.lit("table").alias("fact"), F.col("access").alias("kind"), shown("query").alias("subject"), F.col("table").alias("name"), "locator")
    return a.unionByName(e).unionByName(g).unionByName(t)


GO_SQL = """WITH s AS (SELECT s_suppkey AS k, 'svc/' || s_suppkey || '/a.go' AS path, 'svc%2F' || s_suppkey || '%2Fa.go:p.' AS f FROM supplier)
SELECT path, 'asset' AS fact, 'route' AS kind, 'go_route:' || f || 'Run' AS subject, 'GET /s/' || k AS name, 'L14-L14' AS locator FROM s
UNION ALL SELECT path, 'asset', 'query', 'go_query:' || f || 'Run', 'Query', 'L15-L15' FROM s
UNION ALL SELECT path, 'edge', 'calls', 'go_function:' || f || 'Run', 'go_function:' || f || 'Serve', 'L16-L16' FROM s
UNION ALL SELECT path, 'edge', 'registers', 'go_function:' || f || 'Run', 'go_route:' || f || 'Run', 'L14-L14' FROM s
UNION ALL SELECT path, 'edge', 'handles', 'go_route:' || f || 'Run', 'go_function:' || f || 'Serve', 'L14-L14' FROM s
UNION ALL SELECT path, 'edge', 'queries', 'go_function:' || f || 'Run', 'go_query:' || f || 'Run', 'L15-L15' FROM s
UNION ALL SELECT path, 'gap', 'go_unresolved_sql_receiver', '', '', 'L17-L17' FROM s
UNION ALL SELECT path, 'support', 'route', 'go_route:' || f || 'Run', '', 'L14-L14' FROM s
UNION ALL SELECT path, 'support', 'query', 'go_query:' || f || 'Run', '', unnest(['L8-L8', 'L9-L9']) FROM s
UNION ALL SELECT path, 'table', 'read', 'go_query:' || f || 'Run', 't' || k, 'L15-L15' FROM s"""


#: What stands in a body by the supplier's number modulo 10; # is that number. Fields and constants of a kind stand in HEADS.
BODIES = [
    ("\ttext := \"SELECT id FROM t#\"\n\tdb.Query(text)\n"),
    ("\ttext := \"SELECT id FROM u#\"\n\ttext = \"SELECT id FROM t#\"\n\tdb.Query(text)\n"),
    ("\ttext := \"SELECT id FROM t#\"\n\tif cond {\n\t\ttext = given\n\t}\n\tdb.Query(text)\n"),
    ("\ttext := \"SELECT id FROM t#\"\n\tif cond {\n\t\ttext = \"SELECT id FROM \" + \"t#\"\n\t}\n\tdb.Query(text)\n"),
    ("\ta, err := open()\n\tb := a\n\tc, err := b.Begin()\n\td := c\n\te := d\n\te.Exec(\"DELETE FROM t#\")\n"),
    ("\tvar x *E\n\tx.Query(\"SELECT id FROM t#\")\n"),
    ("\t{\n\t\tdb := 1\n\t\tdb++\n\t}\n\tdb.Query(\"SELECT id FROM t#\")\n\t{\n\t\tdb := given\n\t\tdb.Query(\"SELECT id FROM u#\")\n\t}\n"),
    ("\ts.a.b.c.d.Query(\"SELECT id FROM t#\")\n"),
    ("\tdb.Query(A200)\n\tdb.Query(A100)\n"),
    ("\tdb.Query(\"LARGE\")\n"),
]
HEADS = {
    4: "func open() (*sql.DB, error) { return nil, nil }\n", 5: "type E = D; type D = sql.DB\n", 7: "type S struct { a *T }; type T struct { b U }; type U struct { c *V }; type V struct { d *sql.DB }\n",
    8: "const A0 = \"SELECT id FROM t#\"; " + "; ".join(f"const A{i} = A{i - 1}" for i in range(1, 201)) + "\n",
}


def go_value_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package per supplier: statements in local names, by lines, branches, scopes, results, aliases, fields and constants, and what exceeds a bound."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    content = None
    for k, body in enumerate(BODIES):
        given = "package p\n\nimport \"database/sql\"\n\n" + HEADS.get(k, "\n") + "func Run(db *sql.DB, s *S, given string, cond bool) {\n" + body.replace("LARGE", "x" * 65_537) + "}\n"
        text_of = F.replace(F.lit(given), F.lit("#"), key)
        content = F.when(F.col("s_suppkey") % 10 == k, text_of) if content is None else content.when(F.col("s_suppkey") % 10 == k, text_of)
    facts, tables = gocalls.resolved(materialize.written(scan.facts_of(contents(s, text("svc/", key, "/a.go"), content)), "facts"))
    a = facts.filter("fact in ('asset', 'support') and kind = 'query'").select("path", "fact", F.coalesce("name", F.lit("")).alias("name"), "locator")
    g = facts.filter("fact = 'gap'").select("path", "fact", F.col("kind").alias("name"), "locator")
    return a.unionByName(g).unionByName(tables.select("path", F.col("access").alias("fact"), F.col("table").alias("name"), "locator"))


GO_VALUES_SQL = """WITH rows(kind, fact, name, line) AS (VALUES
(0, 'asset', 'Query', 8), (0, 'support', '', 7), (0, 'read', 't', 8),
(1, 'asset', 'Query', 9), (1, 'support', '', 8), (1, 'read', 't', 9),
(2, 'gap', 'go_dynamic_sql', 11),
(3, 'asset', 'Query', 11), (3, 'support', '', 7), (3, 'support', '', 9), (3, 'read', 't', 11),
(4, 'asset', 'Exec', 12), (4, 'support', '', 12), (4, 'write', 't', 12),
(5, 'asset', 'Query', 8), (5, 'support', '', 8), (5, 'read', 't', 8),
(6, 'asset', 'Query', 11), (6, 'support', '', 11), (6, 'read', 't', 11), (6, 'gap', 'go_unresolved_sql_receiver', 14),
(7, 'asset', 'Query', 7), (7, 'support', '', 7), (7, 'read', 't', 7),
(8, 'gap', 'go_evaluation_limit', 5), (8, 'gap', 'go_evaluation_limit', 7), (8, 'asset', 'Query', 8), (8, 'support', '', 5), (8, 'read', 't', 8),
(9, 'gap', 'go_evaluation_limit', 7))
SELECT 'svc/' || s_suppkey || '/a.go' AS path, fact, CASE WHEN name = 't' THEN 't' || s_suppkey ELSE name END AS name, 'L' || line || '-L' || line AS locator
FROM supplier JOIN rows ON s_suppkey % 10 = kind"""


#: The statement of a supplier's query by its number modulo 6; # is that number.
STATEMENTS = ["SELECT id FROM t#", "UPDATE t# SET a = 1", "SELECT id FROM t#", "DELETE FROM t#", "SELECT id FROM t#", "INSERT INTO shop.t# (id) VALUES (1)"]


def go_table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a project of 25 services, by nation, with a package and its table's declaration per supplier: edges from queries to tables with every place that
    stands for them, and gaps where a table is declared twice (2), outside the service (3), or the query lies in no service (4).
    """
    s = table(spark, sf_dir, "supplier")
    kind, key, home = F.col("s_suppkey") % 6, F.col("s_suppkey").cast("string"), text("svc/", F.col("s_nationkey"), "/", F.col("s_suppkey"), "/")
    statement = F.replace(F.element_at(F.array(*map(F.lit, STATEMENTS)), (kind + 1).cast("int")), F.lit("#"), key)
    code = contents(
        s, F.when(kind == 4, text("lib/", key, "/a.go")).otherwise(text(home, "a.go")),
        text("package p\n\nimport \"database/sql\"\n\nconst said = \"", statement, "\"\n\nfunc Run(db *sql.DB) {\n\tdb.Query(said)\n}\n"),
    )
    declared = text("CREATE TABLE ", F.when(kind == 5, "shop.").otherwise(""), "t", key, " (id int);")
    first = contents(s, F.when(kind == 3, text("ddl/", key, ".sql")).otherwise(text(home, "t.sql")), declared)
    again = contents(s.filter(kind == 2), text(home, "u.sql"), declared)
    nations = [r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    services = Manifest([Service(f"s{n}", "team", f"svc/{n}") for n in sorted(nations)])
    facts = materialize.written(scan.facts_of(code.unionByName(first).unionByName(again)), "facts")
    ledger = ledger_of(spark, facts, services, "", {}, budget=None)
    at = ledger.sources.select(F.col("id").alias("source_id"), "path")
    goals = ledger.assets.filter("kind = 'table'").select(F.col("id").alias("to_id"), F.col("canonical_name").alias("table"))
    edges = ledger.relationships.filter("type in ('reads_table', 'writes_table')").join(goals, "to_id").select(F.col("id").alias("relationship_id"), F.col("type").alias("fact"), "table")
    places = ledger.evidence.filter("relationship_id is not null").join(edges, "relationship_id").join(at, "source_id")
    gaps = ledger.diagnostics.select(F.col("code").alias("fact"), F.lit("").alias("table"), "path", "locator", F.col("message").alias("reason"))
    return places.select("fact", "table", "path", "locator", F.lit("").alias("reason")).unionByName(gaps)


GO_TABLES_SQL = f"""WITH s AS (SELECT s_suppkey % 6 AS kind, 'svc/' || s_nationkey || '/' || s_suppkey || '/' AS home, 'lib/' || s_suppkey || '/' AS lib, CASE WHEN s_suppkey % 6 = 5 THEN 'shop.t' ELSE 't' END || s_suppkey AS name FROM supplier),
e AS (SELECT *, CASE WHEN kind = 0 THEN 'reads_table' ELSE 'writes_table' END AS fact FROM s WHERE kind IN (0, 1, 5))
SELECT fact, name AS "table", home || 'a.go' AS path, unnest(['L5-L5', 'L8-L8']) AS locator, '' AS reason FROM e
UNION ALL SELECT fact, name, home || 't.sql', 'CREATE TABLE ' || name, '' FROM e
UNION ALL SELECT 'go_unresolved_table', '', CASE WHEN kind = 4 THEN lib ELSE home END || 'a.go', 'L8-L8', CASE kind WHEN 2 THEN '{MANY_TABLES.replace("'", "''")}' WHEN 3 THEN '{NO_TABLE.replace("'", "''")}' ELSE '{NO_SERVICE}' END FROM s WHERE kind IN (2, 3, 4)"""


def sqlref_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per order: reads, writes and one that is out of the grammar, by turns."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    sql = (
        F.when(n % 4 == 0, text("SELECT id, COUNT(*) AS n FROM Shop.T", n, " WHERE id = ? AND NOT gone IS NULL ORDER BY id LIMIT 5"))
        .when(n % 4 == 1, text("INSERT INTO \"T", n, "\" (id) VALUES ($1), (2) RETURNING id"))
        .when((n % 4 == 2) & (n % 8 < 4), text("DELETE FROM t", n, " WHERE id IN (1, :two);"))
        .when(n % 4 == 2, text("update Shop.\"T", n, "\" SET a = a + 1, b = COALESCE(?, 'x') WHERE NOT (a <> 2 OR b IS NULL) RETURNING *"))
        .when(n % 8 < 4, text("SELECT a.id FROM t", n, " a JOIN b ON a.id = b.id"))
        .otherwise(text("UPDATE t", n, " SET a = (SELECT 1)"))
    )
    return sql_references(o.select(n.alias("key"), sql.alias("sql")))


SQLREF_SQL = """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'shop' WHEN o_orderkey % 8 = 6 THEN 'shop' ELSE '' END AS schema,
CASE WHEN o_orderkey % 4 = 3 THEN '' WHEN o_orderkey % 4 = 1 OR o_orderkey % 8 = 6 THEN 'T' || o_orderkey ELSE 't' || o_orderkey END AS "table",
CASE o_orderkey % 4 WHEN 0 THEN 'read' WHEN 3 THEN '' ELSE 'write' END AS access, CASE WHEN o_orderkey % 4 = 0 THEN 'SELECT' WHEN o_orderkey % 4 = 1 THEN 'INSERT' WHEN o_orderkey % 8 = 2 THEN 'DELETE' WHEN o_orderkey % 8 = 6 THEN 'UPDATE' ELSE '' END AS operation,
CASE o_orderkey % 4 WHEN 3 THEN 'go_unsupported_sql' ELSE '' END AS error FROM orders"""

QUERIES = {f.__name__: (f, sql) for f, sql in ((ddl_tables, DDL_SQL), (openapi_facts, OPENAPI_SQL), (asyncapi_facts, ASYNCAPI_SQL), (sqlref_facts, SQLREF_SQL), (go_facts, GO_SQL), (go_value_facts, GO_VALUES_SQL), (go_table_edges, GO_TABLES_SQL))}
