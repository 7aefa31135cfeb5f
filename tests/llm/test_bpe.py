import functools
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factgraph.llm import bpe, queries

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", "ΣΑΣ ΟΔΟΣ", "a<|endoftext|>b <|startoftext|>", "İstanbul ǅ ﬁ x²½ ⅷ", "é  x\x85y\x1cz", "日本語 🎉🎉", "don't we'll 'S", "x" * 5000, "ab" * 3000, " \t\n\n  z  ", "​﻿᠎"]


@functools.cache
def library_of(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def as_library(name, texts):
    library = library_of(name)
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    return ids, [library.decode(x, skip_special_tokens=False) for x in ids]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_text_are_the_librarys(name):
    mine = bpe.PairIndexBpe(public_tokenizers.path(name))
    ids, decoded = as_library(name, ODD)
    got = mine.encode_batch(ODD)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == ids
    assert [mine.decode(x) for x in got] == decoded


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=4))
def test_any_text_is_the_librarys(texts):
    ids, decoded = as_library(FILES[0], texts)
    mine = bpe.model(public_tokenizers.path(FILES[0]))
    got = mine.encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == ids
    assert [mine.decode(x) for x in got] == decoded


def test_frame(spark):
    rows = [(1, "Hello world", "a"), (1, "Hello world", "a"), (2, None, "b"), (None, "", None), (3, "w" * 100_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_decode(docs, public_tokenizers.path(FILES[0])).orderBy("doc_id", "text")
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    by = [(r.doc_id, r.decoded) for r in got.collect()]
    assert by[0] == (None, "") and by[1] == by[2] == (1, "hello</w> world</w>") and by[3] == (2, "")
    assert bpe.encode_decode(docs.limit(0), public_tokenizers.path(FILES[0])).count() == 0
    assert got.filter(F.octet_length("ids") == 0).count() == 2


def test_query_as_the_library(spark):
    """The query's digests over the whole table, from the library's ids and text."""
    data = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    ids, decoded = as_library(FILES[0], [t for _, t in rows])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(d.encode())) for (i, _), x, d in zip(rows, ids, decoded, strict=True))
    assert sorted(tuple(r) for r in queries.op1_bpe_encode_decode(spark, data).collect()) == want


def test_long_words_are_not_kept():
    mine = bpe.PairIndexBpe(public_tokenizers.path(FILES[0]))
    mine.encode_batch(["x" * 5000 + " short " + "y" * 300])
    assert [w for w in mine.known if len(w) > bpe.LONG] == [] and "short" in mine.known


def test_words_of_a_full_table_are_not_merged_again(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 4)
    mine = bpe.PairIndexBpe(public_tokenizers.path(FILES[0]))
    merged, merge = [], mine.merge_all
    monkeypatch.setattr(mine, "merge_all", lambda words: merged.extend(words) or merge(words))
    texts = ["one two three four", "one five", "two one", "six seven eight", "one six"]
    got = [mine.encode_batch([t])[0] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == as_library(FILES[0], texts)[0]
    assert sorted(merged) == sorted({w for t in texts for w in t.split()})
    assert len(mine.known) <= 4 and len(mine.older) <= 4


@pytest.mark.parametrize("name", FILES)
def test_near_texts_are_split_alike(name):
    """The standard library's expressions cut as the others do, for each character that they may meet, beside letters, digits, blanks and signs."""
    mine = bpe.PairIndexBpe(public_tokenizers.path(name))
    for c in map(chr, range(0x558)):
        text = f"a{c}b {c}1{c}2 {c}.{c}{c} '{c}\n {c}"
        assert mine.near_words(text) == mine.words(text), hex(ord(c))
