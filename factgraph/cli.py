"""The command line: python -m factgraph.cli VERB [ARGUMENT ...] [--project DIR] [--db DIR] [--format text|json]."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from factgraph import __version__
from factgraph.project import Project
from factgraph.report import RENDERERS

VERBS = {"init": 0, "scan": 0, "ingest": 0, "build": 0, "summary": 0, "verify": 0, "doctor": 0, "explain": 1, "impact": 1, "pack": 1, "path": 2, "ask": 1, "version": 0}


def lines(value: object, indent: str = "") -> list[str]:
    """A plain rendering of a report."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in ([f"{indent}{k}: {v}"] if not isinstance(v, dict | list) else [f"{indent}{k}:", *lines(v, indent + "  ")])]
    if isinstance(value, list):
        return [f"{indent}- {'; '.join(f'{k}: {v}' for k, v in x.items())}" if isinstance(x, dict) else f"{indent}- {x}" for x in value] or [f"{indent}- none"]
    return [f"{indent}{value}"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factgraph")
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("arguments", nargs="*")
    parser.add_argument("--project", default=".")
    parser.add_argument("--db")
    parser.add_argument("--format", choices=("text", "json"), default="text")
    parser.add_argument("--asset", help="what ask is about")
    parser.add_argument("--provider", default="")
    parser.add_argument("--model", default="")
    parser.add_argument("--reply", help="a file with a provider's reply, which ask reads and renders")
    parser.add_argument("--dry-run", action="store_true", help="ask shows its request; it never sends one")
    args = parser.parse_args(argv)
    if args.verb == "ask" and not args.asset:
        parser.error("ask needs --asset")
    if len(args.arguments) != VERBS[args.verb]:
        parser.error(f"{args.verb} takes {VERBS[args.verb]} arguments")
    if args.verb == "version":
        print(__version__)
        return 0
    project = Project(spark or SparkSession.builder.appName("factgraph").getOrCreate(), args.project, args.db)
    text = ""
    try:
        if args.verb == "ask":
            if args.reply:
                with open(args.reply, "rb") as f:
                    result, text = project.answered(f.read(), args.asset, args.provider, args.model)
            else:
                result = project.ask(args.arguments[0], args.asset, args.provider, args.model, args.dry_run)
        else:
            result = project.scan(False) if args.verb == "ingest" else getattr(project, args.verb)(*args.arguments)
    except (ValueError, LookupError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    shown = RENDERERS.get(args.verb, lines)
    print(json.dumps(result, ensure_ascii=False, separators=(",", ":")) if args.format == "json" else text or "\n".join(shown(result)))
    return int(isinstance(result, dict) and (result.get("valid") is False or result.get("healthy") is False))


if __name__ == "__main__":
    sys.exit(main())
