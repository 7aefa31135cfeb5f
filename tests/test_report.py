from factgraph import report

AT = {"path": "a.go", "locator": "L1-L2"}


def test_reports():
    counts = dict.fromkeys(("apis", "operations", "schemas", "services", "packages", "functions", "routes", "queries"), 0)
    assert report.scan({"candidates": 3, "sources": 2, "skipped": 1, "gaps": 0, "tables": 4, **counts}) == ["Scanned 2 of 3 candidates, 1 skipped.", "Found 4 tables.", "0 gaps."]
    link = {"direction": "outgoing", "from_kind": "a", "from_name": "x", "to_kind": "b", "to_name": "y", "type": "calls", "origin": "declared", "evidence": [AT]}
    got = report.explain({"kind": "a", "name": "x", "id": 1, "canonical_name": "x", "attributes": {"k": "v"}, "owners": ["s"], "teams": [], "evidence": [AT], "links": [link], "gaps": [{"code": "c", "message": "m", **AT}]})
    assert got == ["a:x (id:1)", "  k: v", "  owners: s", "  teams: none", "  evidence: a.go (L1-L2)", "Outgoing:", "- a:x --calls (declared)--> b:y", "    evidence: a.go (L1-L2)", "Gaps: 1", "- [c] m a.go (L1-L2)"]
    assert report.path([{"step": 1, "type": "t", "origin": "o", "kind": "b", "name": "y", "evidence": None}]) == ["1. --t (o)--> b:y"] and report.path([]) == ["The two are the same."]
    assert report.impact([{"direction": "incoming", "type": "t", "kind": "k", "name": "n"}]) == ["- depends on it: k:n (t)"]
    assert report.verify({"valid": False, "issues": ["i"]}) == ["The ledger is not valid:", "- i"]
    assert report.doctor({"checks": [{"status": "ok", "name": "n", "message": "m", "fix": ""}]}) == ["[ok] n: m"]
    assert report.build(2) == ["Derived 2 links."] and report.init([]) == ["Everything is there already."]
    whole = report.summary({"sources": 1, "assets": {"api": 1, "table": 0}, "relationships": [], "services": [], "warnings": ["w"], "gaps": [], "last_scan_at": "", "last_build_at": "b"})
    assert whole == ["Sources: 1", "Assets: 1 api", "Relationships: none", "Warnings:", "- w", "Last scan: never", "Last build: b"]
