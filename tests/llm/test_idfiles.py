import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factgraph.llm import idfiles, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["none", "one", "zeros", "random", "skewed", "repeating", "all ids"])
def test_round_trip(kind):
    rng = np.random.default_rng(5)
    ids = {
        "none": [], "one": [65535], "zeros": [0] * 9000, "random": rng.integers(0, 1 << 16, 20_000), "skewed": np.minimum(rng.zipf(1.3, 20_000), 65535),
        "repeating": np.tile(rng.integers(0, 50_000, 37), 400), "all ids": np.arange(1 << 16),
    }[kind]
    ids = np.array(ids, np.uint16)
    data = b"".join(idfiles.pack(np.array([1, 2]), np.array([len(ids), 0]), ids))
    names, lengths, back = idfiles.unpack(data)
    assert names.tolist() == [1, 2] and lengths.tolist() == [len(ids), 0] and (back == ids).all()
    assert kind not in ("zeros", "repeating") or len(data) < 0.3 * 2 * len(ids)


def test_prior_counts_the_whole_file():
    rows = np.tile(np.array([1, 2], np.uint16), 1 << 20).reshape(-1, idfiles.BLOCK)
    rows[1::2, 1::2] = 3  # in every second block 3 follows,
    rows[::2, idfiles.BLOCK // 2 :] = 4  # and in the others 2 does half as often
    assert idfiles.Prior.of(rows.ravel()).follower[1] == 3
    for ids in ([], [1], [1, 2], [1, 2] * 600):
        assert idfiles.Prior.of(np.array(ids, np.uint16)).follower.tolist() == {0: [0], 1: [0, 0], 2: [0, 2, 0]}.get(len(ids), [0, 2, 1])


def test_damage_is_seen():
    data = bytearray(b"".join(idfiles.pack(np.array([1]), np.array([5000]), np.arange(5000, dtype=np.uint16))))
    for at in (3, 40, len(data) - 100):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            idfiles.unpack(bytes(bad))


def expected(rows):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op3_id_files(spark, data).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)


def test_odd_rows(spark):
    rows = [(5, "five"), (3, None), (3, "three"), (None, "no id"), (4, ""), (2, "a<|endoftext|>b  c\n\n d"), (9, "日本 ²½ " * 20_000), (5, "five")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")
    listed = idfiles.write(docs, PATH, most_ids=20)
    got = idfiles.read(listed).toPandas().sort_values(["start"])
    want = expected(rows)
    assert got.start.tolist() == [w[1] for w in want]
    assert [(len(x) // 4, zlib.crc32(x)) for x in got.ids] == [w[2:] for w in want]
    assert idfiles.read(idfiles.write(docs.limit(0), PATH)).count() == 0


def test_words_equal_the_library():
    library, words, rnd = Tokenizer.from_file(PATH), idfiles.Words(PATH), random.Random(1)
    parts = ["'", "'s", "'re", "'ll", "'t", "re", "m", "s", "S", "a", " ", "  ", "\n", "\t", "\u3000", "\xa0", "\x85", "é", "5", "²", "!", "...", "日", "<|endoftext|>", "\u0378", "\U0001f9ff", "x" * 300]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(5000)]
    texts += [c.join(["a ", "b'", " 1", " "]) for c in map(chr, range(0, 0x30000, 7)) if not "\ud800" <= c <= "\udfff"]
    for a in range(0, len(texts), 3000):
        ids, sizes = words(texts[a : a + 3000])
        want = library.encode_batch_fast(texts[a : a + 3000], add_special_tokens=False)
        assert sizes.tolist() == [len(w.ids) for w in want]
        assert ids.tolist() == [i for w in want for i in w.ids]


def test_word_table_is_emptied(monkeypatch):
    monkeypatch.setattr(idfiles, "SLOTS", 64)
    words, library = idfiles.Words(PATH), Tokenizer.from_file(PATH)
    texts = [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(40)]
    ids, sizes = words(texts)
    assert np.split(ids, np.cumsum(sizes))[7].tolist() == library.encode(texts[7]).ids and len(ids) == sum(len(library.encode(t).ids) for t in texts)


def test_blocks_are_smaller_than_zlib_makes_them(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids, sizes = idfiles.Words(PATH)(texts)
    ids = np.insert(ids, np.cumsum(sizes), 0)
    for length in (idfiles.BLOCK, 4 * idfiles.BLOCK):  # four times the length still favours zlib
        plain = sum(len(zlib.compress(ids[a : a + length].tobytes(), 9)) for a in range(0, len(ids), length))
        assert sum(map(len, idfiles.pack(np.arange(len(texts)), sizes + 1, ids))) < 0.9 * plain


def test_a_hot_id_is_cut(spark):
    docs = spark.range(4000).selectExpr("7 doc_id", "concat(md5(cast(id AS string)), ' text') text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    listed = idfiles.write(docs, PATH)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert listed.count() > 1 and idfiles.read(listed).agg({"start": "count"}).first()[0] == 4000


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(idfiles, "CUT", 50)
    library, words, rnd = Tokenizer.from_file(PATH), idfiles.Words(PATH), random.Random(4)
    parts = ["one", " ", "  ", "\n", "don't", "é x", " 1", ". ", "日本", "<|endoftext|>", "x" * 120]
    texts = ["".join(rnd.choice(parts) for _ in range(200)) for _ in range(50)] + ["", "x" * 500, " " * 500]
    assert max(len(idfiles.pieces(t)) for t in texts) > 5 and all("".join(idfiles.pieces(t)) == t for t in texts)
    ids, sizes = words(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def thue_morse(a, b, n=256):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_of_one_hash_stay_apart():
    """Such words have one hash whatever the multiplier: a polynomial modulo 2^64 tells neither pair apart."""
    library = Tokenizer.from_file(PATH)
    words = idfiles.Words(PATH)
    for a, b in (("a", "b"), ("\u4e00", "\u24e0"), ("A", "C")):
        texts = [thue_morse(a, b), thue_morse(b, a)] * 2
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        for seed in range(200):
            words.factor, words.powers = 2 * seed * 0x9E3779B97F4A7C15 % (1 << 64) + 1 | 1, np.ones(1, np.uint64)
            words.clear()
            for given in (texts, texts[:1], texts[1:2], texts[:2]):
                ids, sizes = words(given)
                assert ids.tolist() == [i for w in want[: len(given)] if given != texts[1:2] for i in w] or given == texts[1:2] and ids.tolist() == want[1]


def test_every_word_of_one_hash(monkeypatch):
    monkeypatch.setattr(idfiles.Words, "hashes", lambda self, chars, starts: np.full(len(starts) - 1, 77, np.uint64) + np.diff(starts).astype(np.uint64) % 2)
    library, words = Tokenizer.from_file(PATH), idfiles.Words(PATH)
    texts = ["one two three four", "two, two; 22 three", "", "four", "a b c d e f"] * 3
    for _ in range(2):
        ids, sizes = words(texts)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
