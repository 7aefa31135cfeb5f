import hashlib
import tarfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from factgraph.llm import media, queries


@given(st.text())
def test_png_keeps_every_payload(text):
    payload = media.payload_of(text)
    assert len(payload) % 64 == 0 and payload and payload.rstrip(b"\0") == text.encode("utf-8", "surrogatepass").rstrip(b"\0")
    assert media.from_png(media.to_png(payload)) == payload


def test_damage_is_seen():
    png = bytearray(media.to_png(media.payload_of("some text")))
    png[-20] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(media, "SHARD_BYTES", 4000)
    rows = [(1, "same", "a"), (2, "same", None), (2, None, "b"), (3, "", "c"), (None, "long é " * 20_000, "d"), (4, "x" * 64, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4)
    places = media.store(docs)
    got = sorted(media.load(places).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    for r in got:
        data = (r.text or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.width * r.height == r.payload_bytes and r.bit_depth == 8
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            png = tar.extractfile(f"{r.digest}.png").read()
        assert (len(png), hashlib.sha256(png).hexdigest()) == (r.media_bytes, r.media_sha256)
    assert media.content_index(places).count() == len({r.digest for r in got})
    same = {(r.doc_id, r.digest): (r.media_type, r.width, r.height, r.bit_depth) for r in got}
    assert same == {(r.doc_id, r.digest): (r.media_type, r.width, r.height, r.bit_depth) for r in media.headers(places).collect()}
    assert media.load(media.store(docs.limit(0))).count() == 0


def feature(payload):
    """The feature, a byte at a time."""
    turns = sum((a < 128) != (b < 128) for a, b in zip(payload, payload[1:], strict=False))
    bins = [sum(1 for x in payload if x // 32 == b) for b in range(8)]
    return f"{min(payload)}:{max(payload)}:{sum(payload)}:{sum(x * x for x in payload)}:{turns}:{','.join(map(str, bins))}"


def test_query_as_brute_force(spark):
    """Whole rows of the query, from plain Python; equal texts over several tasks have equal values."""
    rows = [(i, t) for i, t in enumerate([None, "", "one text", "café 日本 " * 50, "z" * 64, "\x00tail"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = media.load(media.store(docs, keep=["doc_id"])).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        png = media.to_png(padded)
        want = (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature(padded))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want
    assert len({tuple(r)[1:] for r in got}) == len({t or "" for t in texts.values()})  # places too


def test_reruns_agree(spark):
    data = "/root/testdata/sf0.001"
    runs = [sorted(queries.op4_media_columns(spark, data).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and not {"shard", "offset"} & set(runs[0][0].asDict())


def test_registered_query_as_brute_force(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op4_media_columns(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        png = media.to_png(padded)
        want = (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature(padded), len(padded), 8)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.width * r.height, r.bit_depth) == want
