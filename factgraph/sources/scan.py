"""From a project's folder to facts: listing on the driver, then reading and extracting on the executors.

Listing sees names only, and is bounded; contents are read where they are extracted, so the project's folder must be visible to the executors.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from factgraph.sources import ddl, documents, gobody, golang

# What is listed and what is not, and the bounds of a scan.
EXTENSIONS = (".json", ".yaml", ".yml", ".sql", ".go")
SKIPPED_FOLDERS = ("node_modules", "vendor")
CREDENTIALS = re.compile(r"^(\.|credentials\.|secrets\.|service-account\.|service_account\.)", re.IGNORECASE)
MOST_FILES = 10_000
MOST_BYTES = 4 << 20
MOST_GO_BYTES = 64 << 20
#: Rows of facts that a task hands on together: what it holds does not grow with the files of a batch.
FLUSH_ROWS = 5000

FACTS = (
    "path string, ordinal int, fact string, kind string, name string, canonical string, attributes map<string,string>, locator string, "
    "from_kind string, from_canonical string, to_kind string, to_canonical string, type string, origin string, detail string"
)
COLUMNS = [c.split()[0] for c in re.sub(r"<[^>]*>", "", FACTS).split(", ")]


class ScanError(ValueError):
    """The scan must not be kept."""


def inside(root: str, path: str) -> bool:
    """The path lies in root, and no part of it below root is a symbolic link."""
    relative = os.path.relpath(path, root)
    if relative.split(os.sep)[0] == ".." or os.path.isabs(relative):
        return False
    at = root
    for part in relative.split(os.sep):
        at = os.path.join(at, part)
        if os.path.islink(at):
            return False
    return True


def listed(root: str) -> list[str]:
    """The candidate files under root, by their path from there, in the order of bytes."""
    found: list[str] = []
    for folder, folders, names in os.walk(root, followlinks=False):
        folders[:] = [f for f in folders if not f.startswith(".") and f not in SKIPPED_FOLDERS and not os.path.islink(os.path.join(folder, f))]
        for name in names:
            path = os.path.join(folder, name)
            if os.path.splitext(name)[1].lower() not in EXTENSIONS or CREDENTIALS.match(name) or name.endswith("_test.go") or os.path.islink(path) or not os.path.isfile(path):
                continue
            found.append(os.path.relpath(path, root).replace(os.sep, "/"))
            if len(found) > MOST_FILES:
                raise ScanError(f"the project exceeds {MOST_FILES} candidate files; select a narrower folder")
    return sorted(found, key=lambda p: p.encode("utf-8", "surrogateescape"))


def bounded(root: str, paths: list[str]) -> list[str]:
    """paths, whose Go sources together must not exceed a scan's bound."""
    if sum(os.path.getsize(os.path.join(root, *p.split("/"))) for p in paths if p.lower().endswith(".go")) > MOST_GO_BYTES:
        raise ScanError(f"the project's Go sources exceed {MOST_GO_BYTES} bytes; select a narrower folder")
    return paths


def read(root: str, path: str) -> bytes:
    whole = os.path.join(root, *path.split("/"))
    if not inside(root, whole) or not os.path.isfile(whole):
        raise ScanError(f"{path} is no regular file inside the project")
    with open(whole, "rb") as f:
        content = f.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ScanError(f"{path} exceeds {MOST_BYTES} bytes")
    return content


def extract(path: str, content: bytes) -> list[dict]:
    """The rows of facts of one file: first that it was seen, then assets, edges, gaps, or one error."""
    rows: list[dict] = []

    def add(fact: str, **values) -> None:
        rows.append(dict.fromkeys(COLUMNS) | {"path": path, "ordinal": len(rows), "fact": fact} | values)

    add("file", name=hashlib.sha256(content).hexdigest())
    try:
        if path.lower().endswith(".go"):
            _extract_go(path, content, add)
            return rows
        text = content.decode("utf-8", "replace")
        if path.lower().endswith(".sql"):
            found = documents.Facts()
            for name, canonical, locator in ddl.tables(text):
                found.asset("table", name, canonical, locator)
            add("source")
        else:
            doc = documents.load(text)
            found = documents.openapi(doc) or documents.asyncapi(doc)
            if found is None:
                return rows
            add("source")
    except documents.DocumentError as e:
        add("error", name=str(e))
        return rows
    for kind, name, canonical, attributes, locator in found.assets:
        add("asset", kind=kind, name=name, canonical=canonical, attributes=attributes, locator=locator)
    for start, end, type_, locator in found.edges:
        add("edge", from_kind=start[0], from_canonical=start[1], to_kind=end[0], to_canonical=end[1], type=type_, origin="declared", locator=locator)
    return rows


def _extract_go(path: str, content: bytes, add) -> None:
    span = lambda a, b: f"L{a}-L{b}"
    file = golang.parse(content.decode("utf-8", "replace"))
    if file.generated:
        if path.endswith(".go"):
            add("gap", kind="generated_file", name="Generated Go source is listed, but not read.", locator="file")
        return
    add("source")
    package = golang.package_key(path, file.package)
    attributes = {"directory": posixpath.dirname(path) or ".", "package": file.package, "analysis": "static_source_inventory"}
    add("asset", kind="package", name=file.package, canonical=package, attributes=attributes, locator=span(file.package_line, file.package_line))
    for key, name, f in golang.function_keys(path, file):
        at = span(f.line, f.last_line)
        own = {"package": file.package, "receiver": f.receiver, "name": f.name, "start_line": str(f.line), "end_line": str(f.last_line)}
        add("asset", kind="function", name=name, canonical=key, attributes=own, locator=at)
        add("edge", from_kind="package", from_canonical=package, to_kind="function", to_canonical=key, type="contains", origin="source-derived", locator=at)
    for name, _, line in file.imports:
        if name == ".":
            add("gap", kind="go_dot_import", name="Names of a dot import are not told from those of the package.", locator=span(line, line))
    for c in file.constraints:
        add("gap", kind="go_build_constraints", name="Build constraints are not evaluated: every variant of the source is read, whatever is built.", locator=span(c.line, c.last_line))
    say = lambda kind, name, owner, where, /, **detail: add("go", kind=kind, name=name, canonical=owner, from_canonical=package, locator=where, detail=json.dumps(detail))
    for name, imported, line in file.imports:
        if name not in (".", "_"):
            say("import", name or imported.rsplit("/", 1)[-1], imported, span(line, line))
    for kind, name, detail in gobody.globals_of(file):
        say(kind, name, "", "file", **{k: v for k, v in detail.items() if k != "fields"})
        for field, type_ in detail.get("fields", {}).items():
            say("field", field, name, "file", type=type_)
    for key, _, f in golang.function_keys(path, file):
        own, results, body, _ = gobody.signature(f)
        given = gobody.signature_params(f)
        symbol = ".".join(x for x in (f.receiver.lstrip("*"), f.name) if x)
        say("function", symbol, key, span(f.line, f.last_line), pointer=f.receiver.startswith("*"), params=given, results=results)
        flow = gobody.flow(own, body)
        always = [(gobody.ALWAYS, -1, gobody.ALWAYS)] if flow.jumps else []
        for event in flow.events:
            say("event", event["name"], key, "file", **{k: v for k, v in event.items() if k != "name"})
        for t, place in flow.uses:
            say("use", t.text, key, "file", at=t.at, later=[dict(zip(("since", "first", "last"), x, strict=True)) for x in (*place.later, *always)])
        for call in gobody.calls(flow.body):
            say("call", call["tail"], key, span(call["line"], call["last"]), chain=call["chain"], tail=call["tail"], first=call["at"], args=call["args"])


def facts_of(contents: DataFrame) -> DataFrame:
    """The facts of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows += extract(path, bytes(content))
                if len(rows) >= FLUSH_ROWS:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=COLUMNS)

    return contents.select("path", "content").mapInPandas(run, FACTS)


def hashes(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, sha256) of files under root, hashed by the tasks that read them; '' for what can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                try:
                    found.append(hashlib.sha256(read(root, path)).hexdigest())
                except (ScanError, OSError):
                    found.append("")
            yield batch.assign(sha256=found)

    return spread(spark, paths).mapInPandas(run, "path string, sha256 string")


def spread(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(64, len(paths) // 16)))


def facts(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The facts of files under root, read by the tasks that extract them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path in batch["path"]:
                try:
                    rows += extract(path, read(root, path))
                except (ScanError, OSError) as e:
                    rows.append(dict.fromkeys(COLUMNS) | {"path": path, "ordinal": 0, "fact": "error", "name": str(e)})
                if len(rows) >= FLUSH_ROWS:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=COLUMNS)

    return spread(spark, paths).mapInPandas(run, FACTS)
