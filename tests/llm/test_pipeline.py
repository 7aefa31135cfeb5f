import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from factgraph.llm import bpe, common, mixing, quality

from .test_linededup import brute as brute_lines
from .test_mixing import brute as brute_mix
from .test_neardup import brute as brute_near

DATA = "/root/testdata/sf0.001"


def test_stages_as_brute_force(spark):
    """Each stage on what the one before kept, against plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    difference = quality.Difference(model.good, model.bad)
    rows = docs.collect()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, DATA)
        got = frame.collect()
        if name == "quality":
            kept = [r for r in rows if 1 / (1 + np.exp(-(model.slope * difference(r.text) + model.offset))) >= 0.3]
            assert sorted(got) == sorted(kept)
        elif name == "line_dedup":
            kept = [(i, t) for i, t, n, gone in brute_lines([(r.doc_id, r.text) for r in rows]) if gone == 0 or gone < n]
            assert sorted((r.doc_id, r.text) for r in got) == sorted(kept) and all(r.n_chars == len(r.text) for r in got)
        elif name == "near_dedup":
            assert sorted(r.doc_id for r in got) == sorted(set(brute_near([(r.doc_id, r.text) for r in rows]).values()))
        elif name == "mix":
            taken = {i: n and t[2] // n for (i, n), t in brute_mix([(r.doc_id, r.text, r.source) for r in rows]).items()}
            assert sorted(r.doc_id for r in got) == sorted(i for i, n in taken.items() for _ in range(n))
        else:
            tokens = bpe.model(public_tokenizers.path("word_bpe_49k.json"))
            assert sorted((r.doc_id, r.ids_sha256) for r in got) == sorted((r.doc_id, hashlib.sha256(x).hexdigest()) for r, x in zip(rows, tokens.encode_batch([r.text for r in rows]), strict=True))
        if name != "encode":
            assert frame.columns == columns
        seen[name], rows = got, got
        docs = spark.createDataFrame(got, frame.schema)
    assert len(seen["near_dedup"]) < len(seen["quality"]) < 200 and mixing.PASSES == 3
    before = len(common.made)
    whole = corpus_pipeline.run(spark, DATA)
    assert [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in common.made[before:]] == ["pipeline-mix"]  # what the other stages have made is deleted
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.select("doc_id", "ids_sha256").collect()) == sorted((r.doc_id, r.ids_sha256) for r in seen["encode"])
    assert whole.filter(F.col("n_tokens") == 0).count() == 0


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns, stage by stage; then no rows at all."""
    clash = {c: f"my {c}" for c in ("_score", "score", "_copy", "copy", "size", "source_size", "target", "taken", "upto", "lines", "dropped", "row", "v", "n", "key", "kept", "gone", "others", "class_id", "ids", "a.b")}
    rows = [(1, None, "a"), (2, "", "a"), (3, "word " * 30_000, "b"), (4, "a plain text of its own that says enough", None), (4, "a plain text of its own that says enough", None), (4, "another text with the same id as those", "a"), (None, "a text that nobody gave an id to", "b"), (5, "\n\n", "b")]
    docs = spark.createDataFrame([(i, t, s, len(t or ""), *clash.values()) for i, t, s in rows], ", ".join(["doc_id long", "text string", "source string", "n_chars long", *(f"`{c}` string" for c in clash)]))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, DATA)
        got = frame.collect()
        seen[name] = got
        if name == "encode":
            assert frame.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "ids"] and all(r.n_tokens for r in got)
            break
        assert frame.columns == docs.columns and frame.schema.simpleString() == docs.schema.simpleString()
        assert all(r[c] == v for r in got for c, v in clash.items())
        docs = spark.createDataFrame(docs.collect(), docs.schema) if name == "quality" else spark.createDataFrame(got, frame.schema)
    key = lambda r: (r.doc_id or 0, r.text or "", r.source or "")
    assert len(seen["line_dedup"]) == len(rows)
    assert sorted(map(key, seen["near_dedup"])) == sorted([(1, "", "a"), (3, rows[2][1], "b"), (4, rows[3][1], ""), (5, "\n\n", "b"), (0, rows[6][1], "b")])
    assert all(r.text for r in seen["mix"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
