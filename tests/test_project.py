import json
import os

import pytest

from factgraph.cli import main
from factgraph.project import Project, VerifyError
from factgraph.sources import manifest, scan

API = """
openapi: 3.0.3
info: {title: SERVICE}
paths:
  /things:
    get: {operationId: listThings, responses: {"200": {schema: {$ref: '#/components/schemas/Thing'}}}}
components: {schemas: {Thing: {}}}
"""


@pytest.fixture
def root(tmp_path):
    for name, thing in (("catalog", "Product"), ("orders", "Order")):
        folder = tmp_path / "services" / name
        folder.mkdir(parents=True)
        (folder / "openapi.yaml").write_text(API.replace("SERVICE", name).replace("Thing", thing))
        (folder / "schema.sql").write_text(f'CREATE TABLE "{thing.lower()}" (id TEXT);')
    (tmp_path / "services/catalog/other.json").write_text('{"neither": 1}')
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.sql").write_text("CREATE TABLE hidden (id int);")
    (tmp_path / "credentials.json").write_text("{}")
    os.symlink(tmp_path / "services/orders/schema.sql", tmp_path / "link.sql")
    (tmp_path / manifest.FILENAME).write_text(
        "version: 1\nservices:\n- {name: catalog, owner: shop-team, source: services/catalog, tags: [b, a]}\n- {name: orders, owner: order-team, source: services/orders/}\n"
    )
    return tmp_path


def test_scan_build_path(spark, root, capsys):
    project = Project(spark, str(root))
    stats = project.scan()
    assert stats == {"candidates": 6, "sources": 4, "skipped": 2, "gaps": 0, "apis": 2, "operations": 2, "schemas": 2, "tables": 2, "services": 2, "packages": 0, "functions": 0, "routes": 0, "queries": 0}
    assert project.verify() == {"valid": True, "issues": []}
    assert project.build() == 2
    got = project.summary()
    assert {(r["type"], r["origin"]): r["n"] for r in got["relationships"]} == {("contains_operation", "declared"): 2, ("matches_table_name", "inferred"): 2, ("owns_asset", "source-derived"): 8, ("references_schema", "declared"): 2}
    steps = project.path("listProducts", "table:product")
    assert [(s["type"], s["name"]) for s in steps] == [("references_schema", "Product"), ("matches_table_name", "product")]
    assert all(s["evidence"] for s in steps) and len(steps[1]["evidence"]) == 2
    with pytest.raises(LookupError, match="no directed path"):
        project.path("table:product", "listProducts")
    with pytest.raises(LookupError, match="no asset"):
        project.explain("hidden")
    about = project.explain("schema:Order")
    assert (about["owners"], about["teams"]) == (["orders"], ["order-team"]) and len(about["links"]) == 3
    assert {r["name"] for r in project.impact("schema:Order")} == {"listOrders", "order", "orders"}
    pack = project.pack("listOrders")
    assert {a["name"] for a in pack["assets"]} == {"listOrders", "orders", "Order", "order"} and len(pack["relationships"]) == 3 and pack["gaps"] == []
    ids = {e["id"] for e in pack["evidence"]}
    assert all(set(x["evidence_ids"]) <= ids and x["evidence_ids"] for x in pack["assets"] + pack["relationships"])
    assert json.dumps(project.pack("listOrders")) == json.dumps(pack)
    asked = project.ask("What breaks?", "listOrders", "openai", "some-model")
    assert asked == project.ask("What breaks?", "listOrders", "openai", "some-model") and "listOrders" in asked["body"]["input"]
    assert main(["ask", "What?", "--asset", "listOrders", "--provider", "openai", "--model", "m", "--project", str(root)], spark) == 1  # neither dry run nor consent
    capsys.readouterr()
    assert project.doctor()["healthy"]
    assert main(["verify", "--project", str(root), "--format", "json"], spark) == 0 and json.loads(capsys.readouterr().out)["valid"]

    (root / "services/orders/schema.sql").write_text("CREATE TABLE renamed (id TEXT);")
    (root / "new.sql").write_text("")
    (root / "services/catalog/other.json").unlink()
    issues = project.verify()["issues"]
    assert len(issues) == 4 and any('"new.sql" is not scanned' in i for i in issues) and any("was removed" in i for i in issues)
    with pytest.raises(VerifyError):
        project.build()
    assert main(["verify", "--project", str(root)], spark) == 1 and not project.doctor()["healthy"]

    before = project.ledger().metadata
    (root / "bad.yaml").write_text("a: [")
    with pytest.raises(scan.ScanError):
        project.scan()
    assert project.ledger().metadata == before
    (root / "bad.yaml").unlink()
    (root / "new.sql").write_text("CREATE TABLE t (x int); CREATE TABLE t (y int);")
    with pytest.raises(scan.ScanError, match="declared twice"):
        project.scan()


@pytest.mark.parametrize("text", ["version: 2", "version: 1\nextra: 1", "version: 1\n---\nversion: 1", "version: 1\nservices: [{name: a, owner: b}]", "version: 1\nservices: [{name: a, owner: b, source: ../x}]", "version: 1\nservices: [{name: a, owner: b, source: x}, {name: a, owner: b, source: y}]", "version: 1\nservices: [{name: a, owner: b, source: x, zone: 1}]"])
def test_bad_manifests(text):
    with pytest.raises(manifest.ManifestError):
        manifest.parse(text)


def test_init_makes_only_what_is_missing(spark, tmp_path):
    project = Project(spark, str(tmp_path))
    assert project.init() == [manifest.FILENAME, ".factgraph"] and project.init() == []
    assert project.scan()["candidates"] == 1


def test_go_packages_span_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.go").write_text(f"package shop\n\nfunc {name.upper()}() {{}}\n")
    (tmp_path / "a_test.go").write_text("package shop\nfunc Hidden() {}\n")
    project = Project(spark, str(tmp_path))
    project.init()
    assert project.scan()["gaps"] == 0
    got = project.summary()["assets"]
    assert (got["package"], got["function"]) == (1, 2)
    assert {r["name"] for r in project.impact("package:shop")} == {"shop.A", "shop.B"}
    assert project.verify()["valid"]


GO = """package shop

import "database/sql"

const items = "items"

func List(db *sql.DB) {
	db.Query("SELECT * FROM " + items)
	db.Exec("DELETE FROM gone")
	helper()
}
"""


def test_go_queries_reach_tables(spark, tmp_path):
    """A query's edge to the table of its service, with the lines of text, constant and declaration; other tables leave a gap."""
    (tmp_path / "svc").mkdir()
    (tmp_path / "svc" / "a.go").write_text(GO)
    (tmp_path / "svc" / "b.go").write_text("package shop\n\nfunc helper() {}\n")
    (tmp_path / "svc" / "t.sql").write_text("CREATE TABLE items (id int);\n")
    (tmp_path / "factgraph.yaml").write_text("version: 1\nservices:\n  - name: shop\n    owner: team\n    source: svc\n")
    project = Project(spark, str(tmp_path))
    stats = project.scan()
    assert [stats[k] for k in ("packages", "functions", "routes", "queries", "tables", "gaps")] == [1, 2, 0, 2, 1, 1]
    ledger = project.ledger()
    assert [(r.code, r.path, r.locator) for r in ledger.diagnostics.collect()] == [("go_unresolved_table", "svc/a.go", "L9-L9")]
    names = {r.id: r.name for r in ledger.assets.collect()}
    edges = {r.id: (names[r.from_id], names[r.to_id], r.type) for r in ledger.relationships.filter("type not in ('owns_asset', 'contains')").collect()}
    assert sorted(edges.values()) == [("Query", "items", "reads_table"), ("shop.List", "Exec", "queries"), ("shop.List", "Query", "queries"), ("shop.List", "shop.helper", "calls")]
    paths = {r.id: r.path for r in ledger.sources.collect()}
    evidence = ledger.evidence.collect()
    assert sorted((paths[e.source_id], e.locator) for e in evidence if edges.get(e.relationship_id, ("", "", ""))[2] == "reads_table") == [("svc/a.go", "L5-L5"), ("svc/a.go", "L8-L8"), ("svc/t.sql", "CREATE TABLE items")]
    package = next(i for i, n in names.items() if n == "shop" and i in {e.asset_id for e in evidence if paths[e.source_id] == "svc/b.go"})
    assert sorted(paths[e.source_id] for e in evidence if e.asset_id == package) == ["svc/a.go", "svc/b.go"]
    assert project.verify() == {"valid": True, "issues": []}
