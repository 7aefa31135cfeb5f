import zlib

import pytest

import numpy as np
import zstandard

from factgraph.llm import quality, queries, toxicity
from factgraph.llm.common import labelled_sample

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "cut", "least"), [("op2_quality", "quality", 0.3, 0.8), ("op8_toxicity", "toxic", 0.5, 0.9)])
def test_held_out(spark, query, label, cut, least):
    got = queries.queries()[query](spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert ((got.score >= cut) == (got.predicted == 1)).all()
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id] == got.held_out.tolist()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held[label]).mean() >= least


@pytest.mark.parametrize("op", [quality, toxicity])
def test_odd_rows_and_no_labels(spark, op):
    schema = "doc_id long, text string, score string, label string"
    docs = spark.createDataFrame([(1, None, "x", "y"), (1, "", "x", None), (None, "é" * 50_000, None, "z"), (2, "plain", "x", "y"), (2, "plain", "x", "y")], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels, value in ((none, 0.5), (spark.createDataFrame([(2, 1, 1), (None, 0, 0), (1, None, None)], none.schema), 1.0)):
        got = op.score(docs, op.fit(docs, labels))
        assert got.columns == ["doc_id", "text", "label", "score"]
        assert [r.score for r in got.collect()] == pytest.approx([value] * 5)
    assert op.score(docs.limit(0), op.fit(docs.limit(0), none)).count() == 0


def test_sample_leaves_out_fold_zero_and_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 30)
    assert len(got) == 60 and sum(y for _, y in got) == 30
    assert all(zlib.crc32(t[1:].encode()) % 5 for t, _ in got)


def test_long_texts_come_whole(spark):
    docs = spark.createDataFrame([(i, "".join(chr(97 + (i + k // 50) % 26) for k in range(50_000 if i < 20 else 2000))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    texts = {r.text for r in docs.collect()}
    got = labelled_sample(docs, labels, "quality", 40)
    assert len(got) > 30 and all(t in texts for t, _ in got)
    assert quality.fit(docs, labels).good


def test_quality_scores_as_brute_force(spark):
    """The fitted model's scores, recomputed block by block in plain Python."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    for r in quality.score(docs, model, keep=["doc_id", "text"]).limit(200).collect():
        data, sizes = (r.text or "").encode(), [0, 0]
        for side, d in enumerate((model.good, model.bad)):
            for a in range(0, len(data), 4096):
                params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes[side] += len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=params).compress(data[a : a + 4096]))
        x = (sizes[1] - sizes[0]) / (len(data) + 64)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.slope * x + model.offset))))


def test_quality_is_calibrated(spark):
    """Of held-out documents with a score near p, a share near p is good."""
    got = queries.op2_quality(spark, "/root/testdata/sf0.1").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    assert abs(got.score.mean() - got.quality.mean()) < 0.05
    assert ((got.score - got.quality) ** 2).mean() < 0.1


def test_toxicity_scores_as_brute_force(spark):
    """The fitted model's scores, from n-grams hashed one character at a time."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.index.tolist(), model.weight.astype(np.float32).tolist(), strict=True))

    def odds(text):
        c, seen = [ord(x) for x in f" {text} ".lower()] if text else [], set()
        for n in (3, 4, 5):
            for a in range(len(c) - n + 1):
                h = c[a]
                for x in c[a + 1 : a + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ x
                seen.add((h * 0x9E3779B1 + n * 0x0C6EF372 & 0xFFFFFFFF) >> 14)
        return model.offset + sum(weight.get(h, 0.0) for h in seen)

    for r in toxicity.score(docs, model, keep=["doc_id", "text"]).limit(100).collect():
        assert r.score == pytest.approx(1 / (1 + np.exp(-odds(r.text))), abs=1e-6)
