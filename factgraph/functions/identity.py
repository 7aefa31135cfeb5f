"""Stable ids: a kind, and the SHA-256 of the JSON list of what identifies a thing."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that the JSON list escapes besides those that all JSON escapes.
ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}


def stable_id(kind: str, *parts: Column) -> Column:
    listed = F.to_json(F.array(*parts))
    for char, escape in ESCAPED.items():
        listed = F.replace(listed, F.lit(char), F.lit(escape))
    return F.concat(F.lit(kind + ":"), F.sha2(listed.cast("binary"), 256))


def fingerprint(content: Column) -> Column:
    """The SHA-256 of a source's bytes, in hexadecimal."""
    return F.sha2(content.cast("binary"), 256)


def stable_id_of(kind: str, *parts: str) -> str:
    """The same on the driver."""
    listed = json.dumps(parts, ensure_ascii=False, separators=(",", ":"))
    for char, escape in ESCAPED.items():
        listed = listed.replace(char, escape)
    return f"{kind}:{hashlib.sha256(listed.encode()).hexdigest()}"
