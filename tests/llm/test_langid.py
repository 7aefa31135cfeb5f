import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import langid, queries

DATA = "/root/testdata/sf0.001"


def phrases(block: bytes, sample: bytes) -> int:
    """Longest matches, by looking for them in the sample itself."""
    at = n = 0
    while at < len(block):
        end = at
        while end < len(block) and sample.find(block[at : end + 1]) >= 0:
            end += 1
        at, n = max(end, at + 1), n + 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_phrases_as_brute_force(seed):
    rng = random.Random(seed)
    letters = "abé中" if seed % 2 else "abcdefghij 语"
    sample = " ".join("".join(rng.choices(letters, k=9)) for _ in range(60)).encode()
    language = langid.Language("x", len(sample), langid.packed(langid.suffix_automaton(sample)))
    blocks = [bytes(rng.choices(sample, k=rng.randint(1, 90))) if i % 3 else rng.choice([b"\xffz", b"zzz", sample[5:40], sample[:3] + b"?" + sample[3:9]]) for i in range(120)]
    sizes, bits = langid.parsed(enumerate(blocks), len(blocks), [language])
    assert sizes.tolist() == [len(b) for b in blocks]
    assert np.allclose(bits[:, 0], [phrases(b, sample) * math.log2(len(sample) + 256) / len(b) for b in blocks])


def test_long_texts_in_blocks():
    sample = b" one two three "
    language = langid.Language("x", len(sample), langid.packed(langid.suffix_automaton(sample)))
    text = "One, two; THREE! " * 40_000 + "4"
    cleaned = langid.pieces(text)
    assert len(cleaned) == math.ceil(len(text) / langid.PIECE) and all(re.fullmatch(rb" ([a-z]+ )*", c) for c in cleaned)
    blocks = [c[i : i + langid.BLOCK] for c in cleaned for i in range(0, len(c), langid.BLOCK)]
    sizes, bits = langid.parsed(langid.blocks_of([None, text]), 2, [language])
    assert sizes.tolist() == [0, sum(map(len, blocks))]
    assert bits[1, 0] == pytest.approx(sum(phrases(b, sample) for b in blocks) * math.log2(len(sample) + 256) / sizes[1])


def test_letters_marks_and_others():
    assert langid.pieces("Ab1c²½ ÄÖ\n\nहिन्दी İ_x") == [" ab c äö हिन्दी i x ".encode()]
    assert langid.pieces("12 ½² ̈ \n") == langid.pieces("") == langid.pieces(None) == []


def model(spark, data, **kw):
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score string, lang_pred string").repartition(2)
    learnable = F.col("doc_id").isNotNull() & (F.col("doc_id") % 5 != 0)
    return df, langid.fit(df, learnable, **kw)


ENGLISH, GERMAN = "the cat sat on the mat and the dog ate it all up. ", "die Katze sitzt auf der Matte und der Hund schläft nicht. "


def test_odd_rows(spark):
    rows = [(1, ENGLISH * 3, "en", "s", "p"), (2, GERMAN * 3, "de", "s", "p"), (3, None, "fr", "s", "p"), (4, "12 34", "xx", "s", "p"), (6, ENGLISH * 3, "en", "s", "p"), (6, ENGLISH * 3, "en", None, None), (7, GERMAN, None, "s", "p"), (None, "qqq www", "zz", "s", "p"), (5, "the mat", "held", "s", "p"), (10, "der Hund", "held", "s", "p"), (11, "", "de", "s", "p"), (15, GERMAN * 20_000, "held", "s", "p")]
    df, languages = model(spark, rows)
    assert [x.name for x in languages] == ["de", "en"]
    got = sorted(((r.doc_id, r.lang, r.lang_pred) for r in langid.identify(df, languages, keep=["doc_id", "lang", "score"]).collect()), key=str)
    want = [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "en"), (6, "en"), (6, "en"), (7, "de"), (10, "de"), (11, "und"), (15, "de")]
    assert [(i, p) for i, _, p in got if i is not None] == sorted(want, key=lambda x: str((x[0], ""))) or sorted((i, p) for i, _, p in got if i is not None) == sorted(want)
    assert all(0 <= r.score <= 1 for r in langid.identify(df, languages).collect())
    none = model(spark, [(5, "only held out", "en", "s", "p"), (None, "no id", "en", "s", "p")])
    assert none[1] == [] and {(r.lang_pred, r.score) for r in langid.identify(none[0], []).collect()} == {("und", 0.0)}
    one = model(spark, [(1, "alone here", "en", "s", "p"), (5, "zzz", None, "s", "p")])
    assert {(r.lang_pred, r.score) for r in langid.identify(*one).collect()} == {("en", 1.0)}
    assert langid.identify(df.limit(0), languages).count() == 0


def test_passages_of_other_languages_are_not_learned(spark):
    rng = random.Random(2)
    say = lambda parts, n: " ".join("".join(rng.choices(parts, k=3)) for _ in range(n))
    a, b = ["th", "er", "on", "ing"], ["sch", "ung", "ver", "eit"]
    rows = [(5 * i + 1, say(a, 60), "a", "", "") for i in range(20)] + [(5 * i + 2, say(b, 60) + (" " + say(a, 60) if i == 7 else ""), "b", "", "") for i in range(20)]
    df, languages = model(spark, rows)
    texts = [say(a, 80) + " " + say(b, 20) for _ in range(20)]
    assert langid.predicted(texts, languages)[0] == ["a"] * 20
    assert [x.bytes_ for x in languages][1] < sum(len(p) for _, t, lang, _, _ in rows if lang == "b" for p in langid.pieces(t)) - 300


def test_copies_do_not_crowd_the_sample(spark):
    rows = [(5 * i + 1, ENGLISH, "en", "", "") for i in range(300)] + [(5 * i + 2, f"{ENGLISH} number {'abcdefghij'[i]} here", "en", "", "") for i in range(10)]
    _, languages = model(spark, rows, rows=11)
    assert languages[0].bytes_ > 10 * len(ENGLISH) - 50


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op13_language(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("fold", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4")).collect()
    assert len(rows) == len(docs) and all(rows[d.doc_id].held_out == (d.fold == 2) for d in docs)
    held = [d for d in docs if d.fold == 2]
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held) and len(held) > 30
