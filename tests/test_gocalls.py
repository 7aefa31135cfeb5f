"""Calls, routes, queries and their tables in Go source, against literal expectations."""

import pytest

from factgraph.operators import gocalls
from factgraph.sources import gobody, golang, scan

FILES = {
    "shop/store.go": """package shop

import (
	"database/sql"
	h "net/http"
)

const base = "SELECT id "
const (
	all = base + from
	same
)

type Store struct {
	db    *sql.DB
	other Other
}

func (s *Store) Items(id int) (*sql.Rows, error) {
	if id > 0 {
		return s.db.Query(all+" WHERE id = ?", id)
	}
	tx, err := s.db.Begin()
	tx.Exec("DELETE FROM Items")
	_ = err
	return s.db.Query("SELECT * FROM a JOIN b")
}

func (s *Store) Late(text string) {
	s.db.Exec(text)
	db := s.db
	db = nil
	db.Exec("DELETE FROM items")
	s.Items(1)
	s.other.Call()
	missing(1)
	twice()
	text.Nothing()
	s.db.Query()
}
""",
    "shop/more.go": """package shop

import h "net/http"

const from = "FROM items"

type Other struct{}

func (Other) Call() {}

type Page struct{}

func (Page) ServeHTTP(w h.ResponseWriter, r *h.Request) {}

type Pointed struct{}

func (p *Pointed) ServeHTTP(w h.ResponseWriter, r *h.Request) {}

func list(w h.ResponseWriter, r *h.Request) {}

func twice() {}

var hook = func() {}

func routes(name string, outer *h.ServeMux) {
	mux := h.NewServeMux()
	mux.HandleFunc("GET /items", list)
	mux.Handle("/page", Page{})
	mux.Handle("/pointed", Pointed{})
	mux.Handle("/address", &Pointed{})
	h.Handle("/wrapped", h.HandlerFunc(list))
	outer.HandleFunc("/"+name, list)
	outer.HandleFunc("/inner", func(w h.ResponseWriter, r *h.Request) { twice() })
	outer.HandleFunc("nothing", list)
	outer.HandleFunc("/one")
	other().Handle("/x", Page{})
	hook()
	func() {}()
}
""",
    "shop/again.go": "package shop\n\nfunc twice() {}\n",
}


@pytest.fixture(scope="module")
def found(spark):
    facts = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FILES.items()], "path string, content binary")
    facts, tables = gocalls.resolved(scan.facts_of(facts))
    return facts.collect(), tables.collect()


def short(key):
    return key.rsplit(":", 1)[-1]


def test_calls(found):
    edges = {(short(r.from_canonical), short(r.to_canonical), r.path, r.locator) for r in found[0] if r.type == "calls"}
    assert edges == {("shop.*Store.Late", "shop.*Store.Items", "shop/store.go", "L34-L34"), ("shop.*Store.Late", "shop.Other.Call", "shop/store.go", "L35-L35")}


def test_routes(found):
    routes = {r.canonical: (r.name, r.attributes["method"], r.attributes["path"]) for r in found[0] if r.kind == "route" and r.fact == "asset"}
    assert sorted(routes.values()) == [("/address", "", "/address"), ("/inner", "", "/inner"), ("/page", "", "/page"), ("/pointed", "", "/pointed"), ("/wrapped", "", "/wrapped"), ("GET /items", "GET", "/items")]
    handled = sorted((routes[r.from_canonical][0], short(r.to_canonical)) for r in found[0] if r.type == "handles")
    assert handled == [("/address", "shop.*Pointed.ServeHTTP"), ("/page", "shop.Page.ServeHTTP"), ("/wrapped", "shop.list"), ("GET /items", "shop.list")]
    assert sum(r.type == "registers" for r in found[0]) == 6


def test_queries_with_the_lines_of_their_constants(found):
    asked = {r.canonical: r for r in found[0] if r.kind == "query" and r.fact == "asset"}
    assert sorted((r.locator, r.name, r.attributes.get("table"), r.attributes.get("access")) for r in asked.values()) == [("L21-L21", "Query", "items", "read"), ("L24-L24", "Exec", "items", "write"), ("L26-L26", "Query", None, None)]
    key = next(k for k, r in asked.items() if r.locator == "L21-L21")
    assert sorted((r.path, r.locator) for r in found[0] if r.fact == "support" and r.canonical == key) == [("shop/more.go", "L5-L5"), ("shop/store.go", "L21-L21"), ("shop/store.go", "L8-L8")]
    assert sorted((t.table, t.access) for t in found[1]) == [("items", "read"), ("items", "write")]
    assert not any("SELECT" in str(r.attributes) + r.name for r in asked.values() if r.attributes.get("operation") != "SELECT")


def test_gaps(found):
    gaps = sorted((r.path[5:-3], r.locator, r.kind) for r in found[0] if r.fact == "gap")
    assert gaps == sorted([
        ("store", "L26-L26", "go_unsupported_sql"), ("store", "L30-L30", "go_dynamic_sql"), ("store", "L33-L33", "go_unresolved_sql_receiver"), ("store", "L37-L37", "go_ambiguous_call"),
        ("store", "L38-L38", "go_unresolved_method"), ("store", "L39-L39", "go_sql_arguments"), ("more", "L29-L29", "go_unresolved_handler"), ("more", "L32-L32", "go_dynamic_route"),
        ("more", "L33-L33", "go_unresolved_handler"), ("more", "L33-L33", "go_ambiguous_call"), ("more", "L34-L34", "go_route_pattern"), ("more", "L35-L35", "go_route_arguments"),
        ("more", "L36-L36", "go_unresolved_route_receiver"), ("more", "L37-L37", "go_unresolved_call"), ("more", "L38-L38", "go_unresolved_call"),
    ])


def test_events_of_a_body():
    f = golang.parse("package a\nfunc f(x *sql.DB, y, z T) (err error) { x = nil; for i := range y { _ = i }; w := &T{}; v, u := g(w); p := &z; if a := []T{}; v { y := p.q } }").functions[0]
    own, _, body, _ = gobody.signature(f)
    shown = [(e["name"], e["declares"], e["opaque"], e["type"]) for e in gobody.flow(own, body).events]
    assert shown == [
        ("x", True, False, "*sql.DB"), ("y", True, False, "T"), ("z", True, False, "T"), ("err", True, False, "error"), ("x", False, False, "read nil"), ("i", True, False, ""), ("w", True, False, "*T"),
        ("v", True, False, "call g"), ("u", True, False, "call g"), ("p", True, False, ""), ("z", False, True, ""), ("a", True, False, ""), ("y", True, False, "read p.q"),
    ]


HEAD = """package p

import (
	h "net/http"
	sq "database/sql"
)

const prefix = "SELECT id FROM "
const q = prefix + "items"

var variable = q
var opened, failed = sq.Open("d", "n")

type fake struct{ mux *h.ServeMux }

func (fake) Query(s string) {}
func (fake) HandleFunc(s string, f func()) {}
func target(w h.ResponseWriter, r *h.Request) {}
func change(s *string) {}
"""

#: name: (body, routes, queries, calls, codes of gaps that must be there, and the others that must not)
BODIES = {
    "aliases": ('h.HandleFunc("/a", target); db.Query("SELECT id FROM items"); target(nil, nil)', 1, 1, 1, []),
    "parameter of a literal": ('func(h fake) { h.HandleFunc("/a", nil) }(fake{})', 0, 0, 1, ["go_unresolved_call"]),
    "local package name": ('h := fake{}; h.HandleFunc("/a", nil)', 0, 0, 1, []),
    "local database": ('db := fake{}; db.Query("SELECT id FROM none")', 0, 0, 1, []),
    "local function": ("target := func() {}; target()", 0, 0, 0, ["go_unresolved_call"]),
    "inner block": ('{ h := fake{}; h.HandleFunc("/a", nil) }; h.HandleFunc("/b", target)', 1, 0, 1, []),
    "inner number": ('{ db := 1; db++ }; db.Query(q)', 0, 1, 0, []),
    "head of an if": ('if h := (fake{}); cond { h.HandleFunc("/a", nil) }; h.HandleFunc("/b", target)', 1, 0, 0, ["go_unresolved_route_receiver"]),
    "range": ('for _, h := range []fake{} { h.HandleFunc("/a", nil) }; h.HandleFunc("/b", target)', 1, 0, 0, ["go_unresolved_route_receiver"]),
    "constant": ("db.Query(q)", 0, 1, 0, []),
    "local sum": ('const end = "items"; text := prefix + end; db.Query(text)', 0, 1, 0, []),
    "made unknown": ("text := q; text = unknown; db.Query(text)", 0, 0, 0, ["go_dynamic_sql"]),
    "made known": ("text := unknown; text = q; db.Query(text)", 0, 1, 0, []),
    "exchanged": ("text, other := q, unknown; text, other = other, text; db.Query(text)", 0, 0, 0, ["go_dynamic_sql"]),
    "exchanged back": ("text, other := unknown, q; text, other = other, text; db.Query(text)", 0, 1, 0, []),
    "branch": ("text := q; if cond { text = unknown }; db.Query(text)", 0, 0, 0, ["go_dynamic_sql"]),
    "branch with the same": ("text := q; if cond { text = q }; db.Query(text)", 0, 1, 0, []),
    "branch with its own": ("text := q; if cond { text := unknown; _ = text }; db.Query(text)", 0, 1, 0, []),
    "within the branch": ("text := unknown; if cond { text = q; db.Query(text) }", 0, 1, 0, []),
    "else": ("text := q; if cond { _ = 1 } else if text == q { _ = 2 } else { text = unknown }; db.Query(text)", 0, 0, 0, ["go_dynamic_sql"]),
    "loop": ("text := q; for cond { db.Query(text); text = unknown }", 0, 0, 0, ["go_dynamic_sql"]),
    "loop that sets first": ("text := unknown; for cond { text = q; db.Query(text); text = unknown }", 0, 1, 0, []),
    "package variable": ("db.Query(variable)", 0, 0, 0, ["go_dynamic_sql"]),
    "address": ("text := q; change(&text); db.Query(text)", 0, 0, 1, ["go_dynamic_sql"]),
    "later address": ("text := q; db.Query(text); p := &text; _ = p", 0, 0, 0, ["go_dynamic_sql"]),
    "literal writes": ("text := q; f := func() { text = unknown }; text = q; f(); db.Query(text)", 0, 0, 0, ["go_dynamic_sql", "go_unresolved_call"]),
    "literal reads early": ("text := q; f := func() { db.Query(text) }; text = unknown; f()", 0, 0, 0, ["go_dynamic_sql", "go_unresolved_call"]),
    "literal reads": ("text := q; f := func() { db.Query(text) }; f()", 0, 1, 0, ["go_unresolved_call"]),
    "goto": ("text := q; again: db.Query(text); text = unknown; if cond { goto again }", 0, 0, 0, ["go_dynamic_sql"]),
    "switch": ("text := q; switch { case cond: text = unknown; fallthrough; default: db.Query(text) }", 0, 0, 0, ["go_dynamic_sql"]),
    "case sets": ("var text string; switch { case cond: text = q; db.Query(text); default: text = unknown }", 0, 1, 0, []),
    "added to": ('text := q; text += " LIMIT 1"; db.Query(text)', 0, 0, 0, ["go_dynamic_sql"]),
    "type changes": ("other := db; other = nil; other.Query(q)", 0, 0, 0, ["go_unresolved_sql_receiver"]),
    "type stays": ("other := db; if cond { other = db }; other.Query(q)", 0, 1, 0, []),
    "package database": ("opened.Query(q)", 0, 1, 0, []),
    "second result": ("_, other := sq.Open(unknown, unknown); other.Query(q)", 0, 0, 0, ["go_unresolved_sql_receiver"]),
    "large": ("db.Query(LARGE)", 0, 0, 0, ["go_evaluation_limit"]),
    "large sum": ("db.Query(HALF + HALF)", 0, 0, 0, ["go_evaluation_limit"]),
}

FILES_OF_BODIES = {f"b{i:02d}/{n}.go": t for i, (body, *_) in enumerate(BODIES.values()) for n, t in (("head", HEAD), ("run", "package p\nimport (h \"net/http\"; sq \"database/sql\")\nfunc run(db *sq.DB, unknown string, cond bool) { " + body.replace("LARGE", '"' + "x" * 65_537 + '"').replace("HALF", '"' + "x" * 40_000 + '"') + " }\n"))}

MADE = {
    "chain/a.go": """package p
import sq "database/sql"
type E = D
type D = sq.DB
type T1 struct { t2 *T2 }
type T2 struct { t3 T3 }
type T3 struct { t4 *T4 }
type T4 struct { db *E }
func first() (*sq.DB, error) { return nil, nil }
func (t *T1) second() *E { return t.t2.t3.t4.db }
func run(t *T1) {
	a, err := first()
	b := a
	c, fail := b.Begin()
	d := c
	e := d
	e.Exec("DELETE FROM made")
	t.second().Query("SELECT id FROM lost")
	s := t.second()
	s.Query("SELECT id FROM second")
	t.t2.t3.t4.db.Query("SELECT id FROM fields")
	u := t.t2.t3
	v := u.t4.db
	v.Query("SELECT id FROM parts")
	x := y
	y := x
	y.Query("SELECT id FROM circle")
	_, _ = err, fail
}
""",
    "lines/a.go": """package p
import "database/sql"
const base = "SELECT id FROM items"
const other = "SELECT id FROM others"
func merged(db *sql.DB, cond bool) {
	query := base
	query = query + ""
	if cond {
		query = "SELECT id FROM items"
	}
	db.Query(query)
}
func replaced(db *sql.DB) {
	query := base
	query = other
	db.Query(query)
}
""",
    "deep/a.go": "package p\nimport \"database/sql\"\nconst A0 = \"SELECT id FROM deep\"\n" + "".join(f"const A{i} = A{i - 1}\n" for i in range(1, 1001)) + "func run(db *sql.DB) { db.Query(A1000); db.Query(A100); db.Query(A126); db.Query(A127) }\n",
    "empty/a.go": 'package p\nimport "database/sql"\nconst A0 = ""\n' + "".join(f"const A{i} = A{i - 1} + A{i - 1}\n" for i in range(1, 13)) + 'func run(db *sql.DB) { db.Query("SELECT id FROM empty" + A12) }\n',
    "types/a.go": 'package p\nimport "database/sql"\ntype A0 = sql.DB\n' + "".join(f"type A{i} = A{i - 1}\n" for i in range(1, 201)) + 'func run(a *A100, b *A200) { a.Query("SELECT id FROM near"); b.Query("SELECT id FROM far") }\n',
    "many/a.go": "package p\nimport \"database/sql\"\n" + "".join(f'const c{i} = "{" " if i else "SELECT id FROM many"}"\n' for i in range(129)) + "func run(db *sql.DB) {\ndb.Query(" + "+".join(f"c{i}" for i in range(128)) + ")\ndb.Query(" + "+".join(f"c{i}" for i in range(129)) + ")\n}\n",
}


@pytest.fixture(scope="module")
def resolved(spark):
    files = FILES_OF_BODIES | MADE
    facts = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary").repartition(4)
    facts, tables = gocalls.resolved(scan.facts_of(facts))
    return facts.collect(), tables.collect()


@pytest.mark.parametrize("name", BODIES)
def test_scopes_and_flow(resolved, name):
    i = list(BODIES).index(name)
    _, routes, queries, calls, gaps = BODIES[name]
    rows = [r for r in resolved[0] if r.path == f"b{i:02d}/run.go"]
    assert [sum(r.fact == "asset" and r.kind == k for r in rows) for k in ("route", "query")] + [sum(r.type == "calls" for r in rows)] == [routes, queries, calls]
    assert sorted({r.kind for r in rows if r.fact == "gap"}) == sorted(gaps)


def of(rows, path, **given):
    return [r for r in rows if r.path == path and all(getattr(r, k) == v for k, v in given.items())]


def test_results_and_fields_to_the_end(resolved):
    assert sorted(t.table for t in of(resolved[1], "chain/a.go")) == ["fields", "made", "parts", "second"]
    assert sorted((r.kind, r.locator) for r in of(resolved[0], "chain/a.go", fact="gap")) == [("go_unresolved_sql_receiver", "L18-L18"), ("go_unresolved_sql_receiver", "L27-L27")]


def test_lines_of_the_events_that_are_met(resolved):
    lines = {}
    for r in resolved[0]:
        if r.fact == "support" and r.path == "lines/a.go":
            lines.setdefault(r.canonical.split("p.")[1].split("#")[0], set()).add(r.locator)
    assert lines == {"merged": {"L3-L3", "L7-L7", "L9-L9"}, "replaced": {"L4-L4"}}


def test_depth(resolved):
    assert [t.table for t in of(resolved[1], "deep/a.go")] == ["deep", "deep"]
    assert sorted(r.kind for r in of(resolved[0], "deep/a.go", fact="gap")) == ["go_evaluation_limit"] * 2
    assert [t.table for t in of(resolved[1], "types/a.go")] == ["near"]
    assert sum(r.kind == "go_evaluation_limit" for r in of(resolved[0], "types/a.go", fact="gap")) == 72


def test_nothing_doubled_is_nothing(resolved):
    assert [t.table for t in of(resolved[1], "empty/a.go")] == ["empty"] and not of(resolved[0], "empty/a.go", fact="gap")
    assert sorted(r.locator for r in of(resolved[0], "empty/a.go", fact="support", kind="query")) == ["L16-L16", "L3-L3"]


def test_origins_are_bounded(resolved):
    assert [t.table for t in of(resolved[1], "many/a.go")] == ["many"]
    assert len(of(resolved[0], "many/a.go", fact="support", kind="query")) == 128
    assert [(r.kind, r.locator) for r in of(resolved[0], "many/a.go", fact="gap")] == [("go_evaluation_limit", "L134-L134")]


def test_budgets_hold_for_all_files_together(spark):
    text = 'package p\nimport "database/sql"\nfunc run(db *sql.DB) {\ndb.Query("SELECT a FROM t")\ndb.Query("SELECT b FROM t")\n}\n'
    facts = scan.facts_of(spark.createDataFrame([(f"{d}/a.go", bytearray(text.encode())) for d in "abc"], "path string, content binary"))
    for budget, kept in (((5, 1 << 20), 2), ((1000, 15 * 4), 4)):
        found, tables = gocalls.resolved(facts, budget)
        found = found.collect()
        assert sorted((r.path, r.locator) for r in found if r.fact == "asset" and r.kind == "query") == [(f"{d}/a.go", f"L{n}-L{n}") for d in "abc" for n in (4, 5)][:kept]
        assert sorted((r.path, r.locator) for r in found if r.kind == "go_evaluation_limit") == [(f"{d}/a.go", f"L{n}-L{n}") for d in "abc" for n in (4, 5)][kept:]


def test_doubling_constants_are_bounded(spark):
    text = "package a\nimport \"database/sql\"\nconst c0 = \"" + "x" * 10_000 + "\"\n" + "\n".join(f"const c{i + 1} = c{i} + c{i}" for i in range(6)) + "\nfunc f(db *sql.DB) { db.Exec(c6) }\n"
    facts, tables = gocalls.resolved(scan.facts_of(spark.createDataFrame([("a.go", bytearray(text.encode()))], "path string, content binary")))
    assert sorted((r.kind, r.locator) for r in facts.filter("fact = 'gap'").collect()) == [("go_evaluation_limit", "L10-L10"), ("go_evaluation_limit", "L6-L6")] and tables.count() == 0
