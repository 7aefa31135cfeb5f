"""The project manifest: which service owns which folder, and what to assist with. Unknown keys are errors."""

from __future__ import annotations

import os
import posixpath
from dataclasses import dataclass, field

from factgraph.sources.documents import DocumentError, load

FILENAME = "factgraph.yaml"
EMPTY = "version: 1\nservices: []\n"
SERVICE_KEYS = {"name", "owner", "source", "domain", "tags"}


class ManifestError(ValueError):
    pass


@dataclass
class Service:
    name: str
    owner: str
    source: str
    domain: str = ""
    tags: list[str] = field(default_factory=list)


@dataclass
class Manifest:
    services: list[Service] = field(default_factory=list)
    assistance: dict[str, str] = field(default_factory=dict)


def _only(value: object, allowed: set[str], what: str) -> dict:
    if not isinstance(value, dict) or value.keys() - allowed:
        raise ManifestError(f"{what} must be a map of {', '.join(sorted(allowed))}")
    return value


def parse(text: str) -> Manifest:
    try:
        doc = load(text)
    except DocumentError as e:
        raise ManifestError(str(e)) from None
    if "\n---" in "\n" + text.lstrip().removeprefix("---"):
        raise ManifestError("a manifest is exactly one document")
    _only(doc, {"version", "services", "assistance"}, "manifest")
    if doc.get("version") != 1:
        raise ManifestError("a manifest must declare version: 1")
    services: list[Service] = []
    for n, entry in enumerate(doc.get("services") or [], 1):
        s = _only(entry, SERVICE_KEYS, f"service {n}")
        source = posixpath.normpath(str(s.get("source") or "").replace(os.sep, "/"))
        if not s.get("name") or not s.get("owner") or source == ".":
            raise ManifestError(f"service {n} needs a name, an owner and a source")
        if source.startswith("/") or source.split("/")[0] == "..":
            raise ManifestError(f"the source of service {s['name']!r} must be a folder inside the project")
        services.append(Service(str(s["name"]), str(s["owner"]), source, str(s.get("domain") or ""), sorted(map(str, s.get("tags") or []))))
    for what in ("name", "source"):
        values = [getattr(s, what) for s in services]
        if repeated := {v for v in values if values.count(v) > 1}:
            raise ManifestError(f"a service {what} is repeated: {', '.join(sorted(repeated))}")
    assistance = _only(doc.get("assistance") or {}, {"provider", "model"}, "assistance")
    return Manifest(sorted(services, key=lambda s: s.name), {k: str(v) for k, v in assistance.items()})
