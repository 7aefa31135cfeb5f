"""API and event descriptions: what an OpenAPI or AsyncAPI document declares, as facts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

try:
    import yaml
except ImportError:  # JSON documents need no YAML
    yaml = None

SCHEMA_REF = "#/components/schemas/"
# The methods of a path, in their order, and the operations of a channel.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
OPERATIONS = ("publish", "subscribe")


class DocumentError(ValueError):
    """A document that must stop a scan."""


class OddMap(list):
    """A map with a key that is no string: it is kept apart, and nothing is looked up in it."""


@dataclass
class Facts:
    """Assets (kind, name, canonical, attributes, locator) and edges ((kind, canonical) of either end, type, locator), in the order of emission."""

    assets: list[tuple[str, str, str, dict[str, str], str]] = field(default_factory=list)
    edges: list[tuple[tuple[str, str], tuple[str, str], str, str]] = field(default_factory=list)

    def asset(self, kind: str, name: str, canonical: str, locator: str, **attributes: str) -> tuple[str, str]:
        self.assets.append((kind, name, canonical, attributes, locator))
        return kind, canonical

    def edge(self, start: tuple[str, str], end: tuple[str, str], type_: str, locator: str) -> None:
        self.edges.append((start, end, type_, locator))


def load(text: str) -> dict:
    """The first document of a YAML or JSON text, which must be a map; repeated keys are errors, and only true and false are booleans."""
    try:
        value = json.loads(text, object_pairs_hook=_pairs)
    except json.JSONDecodeError:
        if yaml is None:
            raise DocumentError("YAML needs PyYAML") from None
        try:
            value = next(iter(yaml.load_all(text, Loader=_loader())), None)
        except yaml.YAMLError as e:
            raise DocumentError(f"malformed document: {e}") from None
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise DocumentError("a document's top level must be a map")
    return value


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise DocumentError("a key is repeated")
    return out


def _loader():
    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {c: [(tag, r) for tag, r in rs if tag != "tag:yaml.org,2002:bool"] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    import re

    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

    def mapping(loader, node):
        loader.flatten_mapping(node)
        pairs = [(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value]
        if any(not isinstance(k, str) for k, _ in pairs):
            return OddMap(pairs)
        return _pairs(pairs)

    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    return Loader


def table(value: object, *keys: str) -> dict:
    """The map at a chain of keys, or an empty one."""
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value if isinstance(value, dict) else {}


def word(value: object, otherwise: str) -> str:
    return value if isinstance(value, str) and value else otherwise


def schema_refs(value: object) -> set[str]:
    """The component schemas that a value refers to, at any depth."""
    found, todo = set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            ref = x.get("$ref")
            if isinstance(ref, str) and ref.startswith(SCHEMA_REF):
                found.add(ref[len(SCHEMA_REF) :])
            todo += x.values()
        elif isinstance(x, list) and not isinstance(x, OddMap):
            todo += x
    return found


def ordered(names) -> list[str]:
    return sorted(names, key=lambda s: s.encode("utf-8", "surrogatepass"))


class _Document:
    """What both kinds have in common: a title, component schemas, and references to them."""

    def __init__(self, doc: dict, kind: str, version_key: str, untitled: str):
        self.facts = Facts()
        title = word(table(doc, "info").get("title"), untitled)
        self.root = self.facts.asset(kind, title, title, "info", **{version_key: doc[version_key]})
        self.schemas = {n: self.facts.asset("schema", n, n, f"components.schemas.{n}") for n in ordered(table(doc, "components", "schemas"))}

    def refer(self, start: tuple[str, str], value: object, locator: str) -> None:
        for name in ordered(schema_refs(value) & self.schemas.keys()):  # other references are not guessed
            self.facts.edge(start, self.schemas[name], "references_schema", locator)


def openapi(doc: dict) -> Facts | None:
    """An OpenAPI document's facts, or None if it is none: its version must be a string."""
    if not isinstance(doc.get("openapi"), str):
        return None
    d = _Document(doc, "api", "openapi", "OpenAPI document")
    for path in ordered(table(doc, "paths")):
        for method in METHODS:
            operation = doc["paths"][path].get(method) if isinstance(doc["paths"][path], dict) else None
            if not isinstance(operation, dict):
                continue
            canonical, at = f"{method.upper()} {path}", f"paths.{path}.{method}"
            op = d.facts.asset("operation", word(operation.get("operationId"), canonical), canonical, at, method=method.upper(), path=path)
            d.facts.edge(d.root, op, "contains_operation", at)
            d.refer(op, operation, at)
    return d.facts


def asyncapi(doc: dict) -> Facts | None:
    """An AsyncAPI document's facts, or None if it is none; DocumentError for a version other than 2 and 3."""
    version = doc.get("asyncapi")
    if not isinstance(version, str):
        return None
    if version[:2] not in ("2.", "3."):
        raise DocumentError(f"unsupported AsyncAPI version {version!r}")
    d = _Document(doc, "asyncapi", "asyncapi", "AsyncAPI document")
    for name in ordered(table(doc, "channels")):
        at = f"channels.{name}"
        channel = d.facts.asset("channel", name, name, at)
        d.facts.edge(d.root, channel, "contains_channel", at)
        for operation in OPERATIONS:
            message = table(doc["channels"], name, operation).get("message")
            if isinstance(message, dict):
                canonical, place = f"{name} {operation}", f"{at}.{operation}.message"
                m = d.facts.asset("message", word(message.get("name"), canonical), canonical, place, operation=operation)
                d.facts.edge(channel, m, "contains_message", place)
                d.refer(m, message, place)
    return d.facts
