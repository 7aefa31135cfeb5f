"""Reports as text: one renderer per verb, from the plain values that the verb returns."""

from __future__ import annotations

from collections.abc import Callable


def place(x: dict) -> str:
    return f"{x['path']} ({x['locator']})" if x.get("locator") else x["path"]


def gaps(listed: list[dict]) -> list[str]:
    return [f"Gaps: {len(listed)}", *(f"- [{g['code']}] {g['message']} {place(g)}" for g in listed)] if listed else []


def evidence(listed: list[dict] | None, indent: str = "  ") -> list[str]:
    return [f"{indent}evidence: {place(e)}" for e in listed or []]


def scan(r: dict) -> list[str]:
    kinds = ", ".join(f"{r[k]} {k}" for k in ("apis", "operations", "schemas", "tables", "services", "packages", "functions", "routes", "queries") if r[k])
    return [f"Scanned {r['sources']} of {r['candidates']} candidates, {r['skipped']} skipped.", f"Found {kinds or 'nothing'}.", f"{r['gaps']} gaps."]


def summary(r: dict) -> list[str]:
    out = [f"Sources: {r['sources']}", "Assets: " + (", ".join(f"{n} {k}" for k, n in r["assets"].items() if n) or "none")]
    out += ["Relationships:", *(f"- {x['type']} ({x['origin']}): {x['n']}" for x in r["relationships"])] if r["relationships"] else ["Relationships: none"]
    out += ["Services:", *(f"- {s['name']}: {s['owner'] or 'no owner'}, {s['source']}" for s in r["services"])] if r["services"] else []
    out += ["Warnings:", *(f"- {w}" for w in r["warnings"])] if r["warnings"] else []
    return [*out, *gaps(r["gaps"]), f"Last scan: {r['last_scan_at'] or 'never'}", f"Last build: {r['last_build_at'] or 'never'}"]


def link(x: dict) -> str:
    return f"{x['from_kind']}:{x['from_name']} --{x['type']} ({x['origin']})--> {x['to_kind']}:{x['to_name']}"


def explain(r: dict) -> list[str]:
    out = [f"{r['kind']}:{r['name']} (id:{r['id']})", *([f"  canonical: {r['canonical_name']}"] if r["canonical_name"] != r["name"] else [])]
    out += [f"  {k}: {v}" for k, v in r["attributes"].items()]
    out += [f"  owners: {', '.join(r['owners']) or 'none'}", f"  teams: {', '.join(r['teams']) or 'none'}", *evidence(r["evidence"])]
    for way in ("outgoing", "incoming"):
        mine = [x for x in r["links"] if x["direction"] == way]
        out += [f"{way.capitalize()}:", *(line for x in mine for line in (f"- {link(x)}", *evidence(x["evidence"], "    ")))] if mine else []
    return [*out, *gaps(r["gaps"])]


def impact(r: list[dict]) -> list[str]:
    said = {"incoming": "depends on it", "outgoing": "it depends on"}
    return [f"- {said[x['direction']]}: {x['kind']}:{x['name']} ({x['type']})" for x in r] or ["Nothing depends on it, and it depends on nothing."]


def path(r: list[dict]) -> list[str]:
    return [line for s in r for line in (f"{s['step']}. --{s['type']} ({s['origin']})--> {s['kind']}:{s['name']}", *evidence(s["evidence"], "   "))] or ["The two are the same."]


def verify(r: dict) -> list[str]:
    return ["The ledger is valid."] if r["valid"] else ["The ledger is not valid:", *(f"- {i}" for i in r["issues"])]


def doctor(r: dict) -> list[str]:
    return [f"[{c['status']}] {c['name']}: {c['message']}" + (f" {c['fix']}" if c["fix"] else "") for c in r["checks"]]


def build(r: int) -> list[str]:
    return [f"Derived {r} links."]


def init(r: list[str]) -> list[str]:
    return [f"Made {x}." for x in r] or ["Everything is there already."]


RENDERERS: dict[str, Callable[..., list[str]]] = {f.__name__: f for f in (init, scan, build, summary, explain, impact, path, verify, doctor)} | {"ingest": scan}
