"""The bounded neighbourhood of an asset: who is admitted, which links lie inside, and whether anything was left out.

Admission is sequential by nature (parents in the order of their admission, then kind, canonical name and path), but never holds more than PACK_ASSETS
assets; so each level fetches the neighbours of at most that many ids, no more than PACK_ASSETS + 1 each, and the driver admits them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions.identity import stable_id
from factgraph.plans.model import PACK_ASSETS, PACK_ATTRIBUTES, PACK_DEPTH, PACK_EVIDENCE, PACK_GAPS, PACK_RELATIONSHIPS, STRUCTURAL, Ledger


@dataclass
class Admitted:
    depth: dict[int, int]  # in the order of admission
    boundary: bool


def symmetric(relationships: DataFrame) -> DataFrame:
    """(id, next) in both directions, so that a neighbour is one equi-join away."""
    r = relationships.filter(~F.col("type").isin(*STRUCTURAL))
    return r.select(F.col("from_id").alias("id"), F.col("to_id").alias("next")).unionByName(r.select(F.col("to_id").alias("id"), F.col("from_id").alias("next")))


def neighbours(ledger: Ledger, ids: list[int], most: int) -> dict[int, list[int]]:
    """The first neighbours of each id by kind, canonical name and path."""
    near = symmetric(ledger.relationships_at(ids)).filter(F.col("id").isin(ids)).distinct()
    a = ledger.assets.select(F.col("id").alias("next"), "kind", "canonical_name", "source_id").join(ledger.sources.select(F.col("id").alias("source_id"), "path"), "source_id")
    order = Window.partitionBy("id").orderBy("kind", "canonical_name", "path", "next")
    ranked = near.join(a, "next").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    found: dict[int, list[tuple[int, int]]] = {}
    for r in ranked.select("id", "n", "next").collect():
        found.setdefault(r.id, []).append((r.n, r.next))
    return {i: [x for _, x in sorted(v)] for i, v in found.items()}


def admit(ledger: Ledger, asset_id: int, depth: int = PACK_DEPTH, most: int = PACK_ASSETS) -> Admitted:
    admitted, boundary, level = {asset_id: 0}, False, [asset_id]
    for d in range(depth + 1):
        near = neighbours(ledger, level, most + 1) if level else {}
        new: list[int] = []
        for parent in level:
            for n in near.get(parent, []):
                if n in admitted:
                    continue
                if d == depth or len(admitted) == most:
                    boundary = True
                    continue
                admitted[n] = d + 1
                new.append(n)
        level = new
    return Admitted(admitted, boundary)


def allowed_attributes(attributes: Column, names: tuple[str, ...] = PACK_ATTRIBUTES) -> Column:
    """The attributes that may leave the ledger."""
    return F.map_filter(attributes, lambda k, _: k.isin(*names))


def pack_assets(ledger: Ledger, admitted: Admitted) -> DataFrame:
    """(asset_id, stable_id, kind, name, depth, attributes) of the admitted, only attributes that may leave the ledger."""
    ids = ledger.assets.sparkSession.createDataFrame([(i, d, n) for n, (i, d) in enumerate(admitted.depth.items())], "id long, depth int, place int")
    a = ledger.assets.join(F.broadcast(ids), "id").join(ledger.sources.select(F.col("id").alias("source_id"), "path"), "source_id")
    allowed = allowed_attributes(F.col("attributes"))
    return a.select(F.col("id").alias("asset_id"), stable_id("asset", F.col("kind"), F.col("path"), F.col("canonical_name")).alias("stable_id"), "kind", "name", "depth", "place", allowed.alias("attributes"))


def pack_relationships(ledger: Ledger, assets: DataFrame) -> tuple[DataFrame, bool]:
    """The links between admitted assets, the first PACK_RELATIONSHIPS by stable id, and whether there are more."""
    ids = assets.select("asset_id", "stable_id")
    admitted = [r.asset_id for r in ids.select("asset_id").collect()]  # PACK_ASSETS at most
    r = ledger.relationships_at(admitted).filter(~F.col("type").isin(*STRUCTURAL))
    inside = r.join(F.broadcast(ids.toDF("from_id", "from_stable")), "from_id").join(F.broadcast(ids.toDF("to_id", "to_stable")), "to_id")
    inside = inside.select(stable_id("relation", *map(F.col, ("from_stable", "to_stable", "type", "origin"))).alias("stable_id"), "from_stable", "to_stable", "type", "origin", F.col("id").alias("relationship_id"))
    first = inside.orderBy("stable_id").limit(PACK_RELATIONSHIPS + 1).collect()
    return ids.sparkSession.createDataFrame(first[:PACK_RELATIONSHIPS], inside.schema), len(first) > PACK_RELATIONSHIPS


def gaps_at(ledger: Ledger, paths: list[str]) -> tuple[DataFrame, bool]:
    """The gaps in files, in their order, as many as a pack takes besides its own two, and whether there are more."""
    first = ledger.diagnostics.filter(F.col("path").isin(paths)).orderBy("path", "locator", "code", "message").limit(PACK_GAPS - 1).collect()
    return ledger.diagnostics.sparkSession.createDataFrame(first[: PACK_GAPS - 2], ledger.diagnostics.schema), len(first) > PACK_GAPS - 2


def pack(ledger: Ledger, asset_id: int) -> dict:
    """The evidence pack of an asset as plain values, everything in the order of stable ids; ValueError where its evidence exceeds PACK_EVIDENCE places."""
    admitted = admit(ledger, asset_id)
    assets = pack_assets(ledger, admitted)
    inside, more = pack_relationships(ledger, assets)
    rows, edges = assets.collect(), inside.collect()
    owns = ledger.relationships_at(list(admitted.depth)).filter("type = 'owns_asset'").filter(F.col("to_id").isin(list(admitted.depth)))
    owned = [(r.to_id, r.from_id, r.id) for r in owns.select("to_id", "from_id", "id").collect()]
    services = {r.id: r.name for r in ledger.assets.filter("kind = 'service'").filter(F.col("id").isin([s for _, s, _ in owned])).select("id", "name").collect()} if owned else {}
    teams = {r.name: r.owner for r in ledger.configs.select("name", "owner").filter(F.col("name").isin(list(services.values()))).collect()} if services else {}
    asset_ids, edge_ids = [*admitted.depth, *services], [*(e.relationship_id for e in edges), *(r for _, _, r in owned)]
    near = ledger.evidence_at(list(admitted.depth))
    at = near.filter(F.col("asset_id").isin(asset_ids) | F.col("relationship_id").isin(edge_ids)) if edge_ids else near.filter(F.col("asset_id").isin(asset_ids))
    at = at.join(ledger.sources.select(F.col("id").alias("source_id"), "path", "sha256"), "source_id")
    at = at.select("asset_id", "relationship_id", stable_id("evidence", F.col("path"), F.col("sha256"), F.col("locator")).alias("id"), "path", "sha256", "locator")
    if len(at.select("id").distinct().limit(PACK_EVIDENCE + 1).collect()) > PACK_EVIDENCE:
        raise ValueError(f"evidence exceeds {PACK_EVIDENCE} locations; select a narrower asset")
    places, of = {}, {}
    for e in at.distinct().collect():  # each of a bounded number of targets with PACK_EVIDENCE places at most
        places[e.id] = {"id": e.id, "source": e.path, "sha256": e.sha256, "locator": e.locator}
        of.setdefault(("asset", e.asset_id) if e.asset_id is not None else ("relationship", e.relationship_id), set()).add(e.id)
    listed = []
    for r in rows:
        mine = set(of.get(("asset", r.asset_id), ()))
        for to, service, rel in owned:
            if to == r.asset_id:
                mine |= of.get(("relationship", rel), set()) | of.get(("asset", service), set())
        who = sorted({(services[s], teams.get(services[s], "")) for to, s, _ in owned if to == r.asset_id and s in services})
        listed.append({"id": r.stable_id, "kind": r.kind, "name": r.name, "attributes": dict(sorted(r.attributes.items())), "owners": [{"name": s, "team": t} for s, t in who], "evidence_ids": sorted(mine)})
    related = [{"id": e.stable_id, "from_id": e.from_stable, "to_id": e.to_stable, "type": e.type, "origin": e.origin, "evidence_ids": sorted(of.get(("relationship", e.relationship_id), ()))} for e in edges]
    boundary = admitted.boundary or more
    paths = sorted({p["source"] for p in places.values()})
    first, more = gaps_at(ledger, paths)
    boundary |= more
    gaps = [{"code": g.code, "message": g.message, "source": g.path, "locator": g.locator} for g in first.collect()]
    if boundary:
        gaps.append({"code": "context_boundary", "message": "The pack ends at four hops, 32 assets, 64 relationships and 64 gaps; what it leaves out may still be there."})
    if not ledger.metadata.get("last_build_at"):
        gaps.append({"code": "not_built", "message": "This scan has not been built, so the pack has no inferred links."})
    return {
        "selected_asset_id": next(r.stable_id for r in rows if r.asset_id == asset_id), "assets": sorted(listed, key=lambda a: a["id"]),
        "relationships": sorted(related, key=lambda e: e["id"]), "evidence": sorted(places.values(), key=lambda p: p["id"]), "gaps": gaps,
    }
