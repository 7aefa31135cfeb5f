"""All six foreign-key checks over the star ledger, against sets in plain Python."""

from collections import Counter

from factgraph import registry
from factgraph.operators import integrity
from factgraph.plans.star import Star

DATA = "/root/testdata/sf0.001"


def test_foreign_keys(spark):
    star = Star(spark, DATA)
    sources = {r.id for r in star.sources().collect() if r.id % 97 != 1}
    all_assets = star.assets().select("id", "source_id").collect()
    assets = [r for r in all_assets if r.id % 89 != 4]
    ids = {r.id for r in assets}
    relations = {r.id: (r.from_id, r.to_id) for r in star.relationships().collect()}
    kept = {i: e for i, e in relations.items() if sum(e) % 83 != 2}
    evidence = star.evidence().collect()
    want = {
        "fk_violations": Counter(("source_id", r.source_id) for r in assets if r.source_id not in sources),
        "fk_violations_of_relationships": Counter((c, e[k]) for e in kept.values() for k, c in enumerate(("from_id", "to_id")) if e[k] not in ids),
        "fk_violations_of_evidence": Counter(("source_id", e.source_id) for e in evidence if e.source_id not in sources)
        + Counter(("asset_id", e.asset_id) for e in evidence if e.asset_id is not None and e.asset_id not in ids)
        + Counter(("relationship_id", relations[e.relationship_id][0] * 1000003 + relations[e.relationship_id][1]) for e in evidence if e.relationship_id is not None and e.relationship_id not in kept),
    }
    for name, expected in want.items():
        got = {(r["column"], r["value"]): r.n for r in registry.queries()[name](spark, DATA).collect()}
        assert got == expected and got


def test_tables_that_grow_are_met_by_merging(spark):
    """Assets meet their sources in the star's relationships, and references the ids that they lead to, however small the tables are."""
    star = Star(spark, DATA)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [source_id" in plan(star.relationships())
    ledger = star.ledger()
    assert "SortMergeJoin [relationship_id" in plan(integrity.foreign_key_violations(ledger, "evidence"))
