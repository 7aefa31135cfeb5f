"""A project's verbs: init, scan, build, verify, doctor, summary, explain, impact, path, pack."""

from __future__ import annotations

import datetime
import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph import assist
from factgraph.operators import derive, integrity, links, neighborhood, paths, summary
from factgraph.plans import store
from factgraph.plans.model import Ledger
from factgraph.plans.normalize import ledger_of
from factgraph.sources import manifest, scan

LEDGER_FOLDER = ".factgraph"


class VerifyError(ValueError):
    pass


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class Project:
    def __init__(self, spark: SparkSession, root: str, ledger: str | None = None):
        self.spark, self.root = spark, os.path.abspath(root)
        self.folder = ledger or os.path.join(self.root, LEDGER_FOLDER)

    def init(self) -> list[str]:
        """The manifest and the ledger's folder, where there are none yet; what was made."""
        made = []
        try:
            with open(os.path.join(self.root, manifest.FILENAME), "x", encoding="utf-8") as f:
                f.write(manifest.EMPTY)
            made.append(manifest.FILENAME)
        except FileExistsError:
            pass
        if not os.path.isdir(self.folder):
            os.makedirs(self.folder, mode=0o700)
            made.append(os.path.basename(self.folder))
        return made

    def manifest(self) -> tuple[manifest.Manifest, bytes]:
        content = scan.read(self.root, manifest.FILENAME)
        found = manifest.parse(content.decode("utf-8"))
        for s in found.services:
            path = os.path.join(self.root, *s.source.split("/"))
            if not scan.inside(self.root, path) or not os.path.isdir(path):
                raise manifest.ManifestError(f"the source {s.source!r} of service {s.name!r} is no folder inside the project")
        return found, content

    def scan(self, with_manifest: bool = True) -> dict:
        """Replaces the ledger by what the sources say now; the old one stays if anything fails."""
        parent = store.current(self.spark, self.folder)
        services, content = self.manifest() if with_manifest else (None, b"")
        listed = [p for p in scan.listed(self.root) if p != manifest.FILENAME or not with_manifest]
        facts = scan.facts(self.spark, self.root, scan.bounded(self.root, listed)).persist()
        try:
            extra = self.spark.createDataFrame([(manifest.FILENAME, 0, "file", hashlib.sha256(content).hexdigest())], "path string, ordinal int, fact string, name string")
            whole = facts.unionByName(extra, allowMissingColumns=True) if with_manifest else facts
            ledger = ledger_of(self.spark, whole, services, hashlib.sha256(content).hexdigest(), {"project_root": self.root, "last_scan_at": now()})
            os.makedirs(self.folder, mode=0o700, exist_ok=True)
            store.save(ledger, self.folder, parent)
            counts = {r.fact: r.n for r in facts.groupBy("fact").agg(F.count(F.lit(1)).alias("n")).collect()}
            kept = self.ledger()
            kinds = {r.kind: r.n for r in summary.by_kind(kept.assets).collect()}
            files = counts.get("file", 0) + (1 if with_manifest else 0)
            return {
                "candidates": files, "sources": counts.get("source", 0), "skipped": files - counts.get("source", 0), "gaps": kept.diagnostics.count(),
                "apis": kinds.get("api", 0) + kinds.get("asyncapi", 0), "operations": kinds.get("operation", 0), "schemas": kinds.get("schema", 0), "tables": kinds.get("table", 0),
                "packages": kinds.get("package", 0), "functions": kinds.get("function", 0), "routes": kinds.get("route", 0), "queries": kinds.get("query", 0),
                "services": len(services.services) if services else 0,
            }
        finally:
            facts.unpersist()

    def ledger(self) -> Ledger:
        return store.load(self.spark, self.folder)

    def inventory(self) -> DataFrame:
        return scan.hashes(self.spark, self.root, scan.listed(self.root))

    # The sentences of issues and checks, which scripts look for.

    def issues(self, ledger: Ledger) -> list[str]:
        found = integrity.structural_issues(ledger)
        root = ledger.metadata.get("project_root", "")
        if not root:
            return sorted({*found, "project root is not recorded; rerun scan or ingest"})
        if root != self.root or not os.path.isdir(root) or os.path.islink(root):
            return sorted({*found, "recorded project root is missing or is a symlink; restore it and rerun scan"})
        for c in ledger.configs.collect():
            path = os.path.join(root, *c.source_root.split("/"))
            if not os.path.isdir(path) or not scan.inside(root, path):
                found.append(f'service "{c.name}" source root "{c.source_root}" is missing or invalid; update {manifest.FILENAME} and rerun scan')
        there = self.inventory()
        changed = integrity.inventory_diff(ledger.sources.select("path", "sha256"), there).filter("change <> 'added'")
        for r in changed.collect():
            found.append(f'evidence source "{r.path}" ' + ("is unavailable; rerun scan after restoring it" if r.change == "removed" else "changed since scan; rerun scan and build"))
        return sorted({*found, *integrity.drift_issues(ledger.files, there)})

    def verify(self) -> dict:
        issues = self.issues(self.ledger())
        return {"valid": not issues, "issues": issues}

    def build(self) -> int:
        """Derived links anew, if the ledger is whole and current; how many there are."""
        ledger = self.ledger()
        if issues := self.issues(ledger):
            raise VerifyError("; ".join(issues))
        built = derive.build(ledger, now())
        store.save(built, self.folder, ledger.commit)
        return derive.name_links(ledger.assets).count()

    def doctor(self) -> dict:
        checks = []

        def check(status: str, name: str, message: str, fix: str = "") -> None:
            checks.append({"status": status, "name": name, "message": message, "fix": fix})

        try:
            self.manifest()
            check("ok", "manifest", "Manifest is valid.")
        except (OSError, ValueError) as e:
            check("failure", "manifest", str(e), f"Fix {manifest.FILENAME}, then scan.")
        try:
            ledger = self.ledger()
        except store.StoreError:
            ledger = Ledger.empty(self.spark)
        issues = self.issues(ledger)
        check("failure", "evidence", issues[0], "Restore sources or configuration, then scan and build.") if issues else check("ok", "evidence", "Ledger evidence and service roots are valid.")
        if not ledger.metadata.get("project_root"):
            check("warning", "scan", "No completed scan is recorded.", "Scan.")
        elif not ledger.metadata.get("last_build_at"):
            check("warning", "build", "Inferred links are missing or older than the last scan.", "Build.")
        else:
            check("ok", "build", "Ledger is built from the latest scan.")
        if gaps := ledger.diagnostics.count():
            check("warning", "coverage", f"{gaps} extraction gaps; a static inventory is not an exhaustive impact map.", "See the summary.")
        return {"healthy": all(c["status"] != "failure" for c in checks), "checks": checks}

    def summary(self) -> dict:
        ledger = self.ledger()
        return {
            "sources": ledger.sources.count(), "assets": summary.counters(ledger.assets).first().asDict(),
            "relationships": [r.asDict() for r in summary.by_type(ledger.relationships).orderBy("type", "origin").collect()],
            "services": [{"name": c.name, "owner": c.owner, "source": c.source_root} for c in ledger.configs.orderBy("name").collect()],
            "warnings": self.issues(ledger), "gaps": [r.asDict() for r in summary.diagnostics(ledger).collect()],
            "last_scan_at": ledger.metadata.get("last_scan_at", ""), "last_build_at": ledger.metadata.get("last_build_at", ""),
        }

    def explain(self, selector: str) -> dict:
        from factgraph.operators import ownership

        ledger = self.ledger()
        asset = links.resolve(ledger.assets, selector)
        own = links.evidence_lists(ledger.evidence.filter(F.col("asset_id") == asset.id), ledger.sources, "asset_id").first()
        evidence = [e.asDict() for e in own.evidence] if own else []
        paths_ = [e["path"] for e in evidence]
        return {
            "id": asset.id, "kind": asset.kind, "name": asset.name, "canonical_name": asset.canonical_name, "attributes": dict(sorted((asset.attributes or {}).items())),
            "owners": sorted(r.owner for r in ownership.owners(ledger.relationships, ledger.assets).filter(F.col("asset_id") == asset.id).collect()),
            "teams": sorted(r.team for r in ownership.teams(ledger.relationships, ledger.assets, ledger.configs).filter(F.col("asset_id") == asset.id).collect()),
            "evidence": evidence, "links": [r.asDict(recursive=True) for r in links.explain(ledger, asset.id).collect()],
            "gaps": [r.asDict() for r in summary.diagnostics(ledger).filter(F.col("path").isin(paths_)).collect()] if paths_ else [],
        }

    def impact(self, selector: str) -> list[dict]:
        ledger = self.ledger()
        asset = links.resolve(ledger.assets, selector)
        return [r.asDict() for r in links.impact(ledger, asset.id).orderBy(F.col("direction") == "incoming", "type", "kind", "name").collect()]

    def path(self, start: str, goal: str) -> list[dict]:
        ledger = self.ledger()
        a, b = links.resolve(ledger.assets, start), links.resolve(ledger.assets, goal)
        steps = paths.shortest_path(ledger.relationships, ledger.assets, a.id, b.id)
        of = links.evidence_lists(ledger.evidence.join(F.broadcast(steps.select("relationship_id")), "relationship_id", "left_semi"), ledger.sources)
        return [r.asDict(recursive=True) for r in steps.join(of, "relationship_id", "left").orderBy("step").collect()]

    def pack(self, selector: str) -> dict:
        """The evidence pack of an asset; refused where the ledger is of another project, or not whole and current."""
        ledger = self.ledger()
        if ledger.metadata.get("project_root") != self.root:
            raise VerifyError("the ledger belongs to a different project root; scan this project first")
        if issues := self.issues(ledger):
            raise VerifyError("; ".join(issues))
        return neighborhood.pack(ledger, links.resolve(ledger.assets, selector).id)

    def answered(self, reply: bytes, selector: str, provider: str = "", model: str = "") -> tuple[dict, str]:
        """A provider's reply about an asset's pack, read strictly: the proposal, and its rendering."""
        chosen, pack = self.manifest()[0].assistance, self.pack(selector)
        provider, model = provider or chosen.get("provider", ""), model or chosen.get("model", "")
        text, usage = assist.read_reply(reply, provider)
        proposal = assist.parse_proposal(text, pack, provider, model, usage)
        return proposal, assist.render(proposal, pack)

    def ask(self, question: str, selector: str, provider: str = "", model: str = "", dry_run: bool = True) -> dict:
        """The request that would ask about an asset's pack; provider and model are the manifest's unless given."""
        chosen = self.manifest()[0].assistance
        return assist.prepare(self.pack(selector), question, provider or chosen.get("provider", ""), model or chosen.get("model", ""), dry_run)
