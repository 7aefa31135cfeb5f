import random
import pytest

from factgraph.sources import ddl, documents, golang, queries, scan, sqlref

ACCEPTED = [
    ("SELECT id, name FROM items WHERE id = $1", "", "items", "read"),
    ("SELECT * FROM shop.items", "shop", "items", "read"),
    ('SELECT "Id" FROM "Shop"."Items";', "Shop", "Items", "read"),
    ("select count(*) from Items where (id > ? and name like ?) or gone is null", "", "items", "read"),
    ("SELECT COUNT(*) AS n FROM items", "", "items", "read"),
    ("SELECT items.* FROM items", "", "items", "read"),
    ("SELECT i.id FROM items AS i WHERE i.id IN (1, 2, ?) ORDER BY i.id DESC LIMIT 10 OFFSET 2", "", "items", "read"),
    ("SELECT -price + 2 * (1.5 - tax) total, MAX(a, b) FROM items i", "", "items", "read"),
    ("INSERT INTO items (id, name) VALUES (?, ?), (?, 'it''s') RETURNING id", "", "items", "write"),
    ("UPDATE shop.items SET name = ?, n = n + 1 WHERE NOT id <> ?", "shop", "items", "write"),
    ("DELETE FROM items WHERE id = :id RETURNING *", "", "items", "write"),
    ("/* FROM bogus */ SELECT name FROM `items` WHERE name = 'FROM no_table' -- JOIN ghosts", "", "items", "read"),
]
REFUSED = [
    "", "SELECT", "SELECT FROM items", "SELECT id items", "SELECT id FROM", "SELECT id FROM a JOIN b ON a.id = b.id", "SELECT id FROM a, b",
    "WITH a AS (SELECT id FROM b) SELECT id FROM a", "SELECT id FROM (SELECT id FROM a) b", "SELECT (SELECT id FROM a) FROM b", "SELECT id FROM a UNION SELECT id FROM b",
    "SELECT id FROM a; DELETE FROM b", "SELECT id FROM a WHERE", "SELECT id FROM a WHERE id IN (SELECT 1)", "SELECT id FROM a GROUP BY id", "SELECT id FROM a WHERE id =",
    "SELECT id FROM a WHERE id = ? rest", "INSERT INTO a SELECT id FROM b", "INSERT INTO a (id) VALUES", "INSERT INTO a (id) VALUES (?) ON CONFLICT DO NOTHING", "UPDATE a",
    "UPDATE a SET = ?", "UPDATE a SET id = *", "INSERT INTO a (id) VALUES (*)", "SELECT * * FROM a", "SELECT id FROM a WHERE * = ?", "SELECT id FROM a LIMIT 'ten'", "DELETE a",
    "SELECT id FROM a /* open", "SELECT id FROM a WHERE n = 'open", r"SELECT id FROM a WHERE n = 'back\slash'", "SELECT id FROM a WHERE n = E'x'", "SELECT other(id) FROM a",
    "SELECT id FROM a WHERE id = $", "SELECT id FROM a WHERE id = !", "SELECT id FROM a WHERE id BETWEEN 1 AND 2", "SELECT id FROM a WHERE id NOT IN (1)", "SELECT DISTINCT id FROM a",
    "SELECT id FROM a WHERE (id) = 3", "/*! hint */ SELECT id FROM a", "SELECT id FROM a /* x /* y */ */", 'SELECT id FROM ""', "SELECT 1. FROM a",
]


@pytest.mark.parametrize(("sql", "schema", "table", "access"), ACCEPTED)
def test_accepted(sql, schema, table, access):
    got = sqlref.recognize(sql)
    assert (got.schema, got.table, got.access) == (schema, table, access)


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(sql):
    with pytest.raises(sqlref.NotRecognized):
        sqlref.recognize(sql)


def test_nesting_is_bounded():
    assert sqlref.recognize("SELECT " + "(" * 90 + "1" + ")" * 90 + " FROM a").table == "a"
    for deep in ("(" * 101 + "1" + ")" * 101, "1" + "+1" * 101):
        with pytest.raises(sqlref.NotRecognized):
            sqlref.recognize(f"SELECT {deep} FROM a")


def test_only_the_real_table():
    text = """
    SELECT 'CREATE TABLE in_string (id int);'; -- CREATE TABLE in_comment (id int);
    /* CREATE TABLE nested /* (id int); */ CREATE TABLE outer_comment (id int); */
    CREATE FUNCTION f() AS $body$ CREATE TABLE in_body (id int); $body$;
    /*!40000 x */ CREATE TABLE executable (id int);
    CREATE TABLE copied AS SELECT 1;
    CREATE OR REPLACE TABLE replaced (id int);
    SELECT "; CREATE TABLE quoted (id int)", `;`, [;];
    CREATE TABLE "a.b" (id int);
    create temp table if not exists "Shop" . [Items] (id int);
    """
    assert ddl.tables(text) == [("Items", "Shop.Items", 'CREATE TABLE "Shop" . [Items]')]


def test_odd_ddl():
    assert ddl.tables("") == ddl.tables(";;;") == ddl.tables("CREATE TABLE x") == []
    assert [t[1] for t in ddl.tables("CREATE TABLE a (x int); CREATE TABLE b.c(y int) -- end")] == ["a", "b.c"]
    assert ddl.tables("CREATE TABLE a (d text default '\\'; CREATE TABLE b (x int);');") == [("a", "a", "CREATE TABLE a")]
    assert ddl.tables("SELECT '" + "x" * 100_000) == []


OPENAPI = """
openapi: 3.0.3
info: {title: Shop}
paths:
  /items:
    post: {operationId: addItem, requestBody: {$ref: '#/components/schemas/Item'}}
    get:
      responses:
        "200": {content: {json: {schema: {type: array, items: {$ref: "#/components/schemas/Item"}}}}}
        404: {$ref: "#/components/schemas/Gone"}
    x-other: {}
components:
  schemas: {Item: {}, Gone: {}}
"""


def test_openapi():
    got = documents.openapi(documents.load(OPENAPI))
    assert [(a[0], a[1], a[2]) for a in got.assets] == [("api", "Shop", "Shop"), ("schema", "Gone", "Gone"), ("schema", "Item", "Item"), ("operation", "GET /items", "GET /items"), ("operation", "addItem", "POST /items")]
    refs = [(e[0][1], e[1][1]) for e in got.edges if e[2] == "references_schema"]
    assert refs == [("POST /items", "Item")]  # a response map with a bare number as key is not looked into


def test_asyncapi():
    text = "asyncapi: '2.6.0'\nchannels:\n  paid:\n    publish: {message: {name: Paid, payload: {$ref: '#/components/schemas/Bill'}}}\n    subscribe: {message: {payload: {$ref: 'other.yaml#/X'}}}\ncomponents: {schemas: {Bill: {}}}"
    got = documents.asyncapi(documents.load(text))
    assert [a[:3] for a in got.assets] == [("asyncapi", "AsyncAPI document", "AsyncAPI document"), ("schema", "Bill", "Bill"), ("channel", "paid", "paid"), ("message", "Paid", "paid publish"), ("message", "paid subscribe", "paid subscribe")]
    assert [e[2] for e in got.edges] == ["contains_channel", "contains_message", "references_schema", "contains_message"]
    with pytest.raises(documents.DocumentError):
        documents.asyncapi({"asyncapi": "1.0.0"})


@pytest.mark.parametrize("text", ["[1]", "a: 1\na: 2", "a: [", '{"a": 1, "a": 2}', "just words"])
def test_documents_that_stop_a_scan(text):
    with pytest.raises(documents.DocumentError):
        documents.load(text)


def test_yaml_words():
    assert documents.load("on: yes\nb: true\n---\nc: 1") == {"on": "yes", "b": True}
    assert documents.openapi(documents.load("openapi: 3.0")) is None and documents.openapi({}) is None


GO = """//go:build linux

// Package shop sells.
package shop

import (
	"net/http"
	. "fmt"
)

type Store struct{ n int }

const text = `func fake() {
}`

func init() {}
func init() { x := "}" ; _ = x }

// List lists.
func (s *Store) List(w http.ResponseWriter, r *http.Request) error {
	if s.n > 0 { return nil }
	return func() error { return nil }()
}

func (Box[T]) Get() (v T, err error) { return }
func Map[K comparable, V any](m map[K]V) []V
var f = func() {}
"""


def test_go_declarations():
    rows = scan.extract("shop/store.go", GO.encode())
    functions = [(r["name"], r["canonical"], r["locator"]) for r in rows if r["kind"] == "function" and r["fact"] == "asset"]
    at = "go_function:shop%2Fstore.go:shop."
    assert functions == [
        ("shop.init", f"{at}init:16", "L16-L16"), ("shop.init", f"{at}init:17", "L17-L17"), ("shop.*Store.List", f"{at}*Store.List".replace("*", "*"), "L20-L23"),
        ("shop.Box.Get", f"{at}Box.Get", "L25-L25"), ("shop.Map", f"{at}Map", "L26-L26"),
    ]
    assert [(r["kind"], r["locator"]) for r in rows if r["fact"] == "gap"] == [("go_dot_import", "L8-L8"), ("go_build_constraints", "L1-L1")]
    assert sum(r["type"] == "contains" for r in rows) == 5


def test_go_identity_survives_moved_lines():
    keys = lambda text: [k for k, _, f in golang.function_keys("a.go", golang.parse(text)) if f.name != "init"]
    assert keys(GO) == keys("\n\n" + GO)


@pytest.mark.parametrize("text", ["", "func f() {}", "package", "package a\nfunc f( {}", "package a\nx := 1", "package a\nfunc () {}", "package a\nvar s = \"open", "package a\nfunc f() { ]"])
def test_bad_go(text):
    assert [r["fact"] for r in scan.extract("a.go", text.encode())] == ["file", "error"]


def test_generated_go():
    assert [r["kind"] for r in scan.extract("a.go", b"// Code generated by x. DO NOT EDIT.\npackage a\nfunc F() {}\n")] == [None, "generated_file"]
    assert len(scan.extract("a.go", b"package a\n// Code generated by x. DO NOT EDIT.\nfunc F() {}\n")) > 3


def test_ascii_tokens_are_those_of_all_text():
    bits = ["'", "''", '"', "`", "/*", "*/", "--", "\n", " ", "\x0b", "\x1c", "\\", "a", "Ab", "_x", "1", "1.2", "1.", ".", "?", "$1", ":two", "<=", "<>", "!", "!=", "(", ",", ";", "/*!", "*", "SELECT", "\x00"]
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(1, 9)))
        at = 0
        while at < len(text):
            slow, fast = sqlref._TOKEN.match(text, at), sqlref._ASCII_TOKEN.match(text, at)
            assert (slow and (slow.end(), slow.lastgroup)) == (fast and (fast.end(), fast.lastgroup)), text
            if not slow:
                break
            at = slow.end()


def test_facts_are_handed_on_in_parts(spark, monkeypatch):
    files = spark.createDataFrame([(f"t{i}.sql", bytearray(f"CREATE TABLE a{i} (x int);", "ascii")) for i in range(5)], "path string, content binary")
    whole = sorted(map(str, scan.facts_of(files).collect()))
    monkeypatch.setattr(scan, "FLUSH_ROWS", 2)
    assert sorted(map(str, scan.facts_of(files).collect())) == whole and len(whole) == 15


@pytest.mark.parametrize("query", [queries.go_facts, queries.go_value_facts])
def test_go_files_are_extracted_once_by_many_tasks(spark, monkeypatch, query):
    files, given = [], []
    extract = scan.facts_of
    monkeypatch.setattr(scan, "facts_of", lambda contents: files.append(contents) or extract(contents))
    monkeypatch.setattr(queries.gocalls, "resolved", lambda facts: given.append(facts) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        query(spark, "/root/testdata/sf0.01")
    assert sum(n > 0 for n in files[0].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) >= 4
    assert "MapInPandas" not in given[0]._jdf.queryExecution().executedPlan().toString()
