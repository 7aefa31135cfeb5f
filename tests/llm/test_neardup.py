from itertools import combinations

import numpy as np
import pytest

from factgraph.llm import neardup


def close(a, b, weighted, least):
    """By weighted similarity, or by plain similarity where the weighted one is not far below."""
    x, y = set(a[0].tolist()), set(b[0].tolist())
    return weighted >= least or bool(x) and weighted >= least / (least + (1 - least) * 1.5) and len(x & y) / len(x | y) >= least


def brute(rows, least=0.8):
    """Classes by comparing all pairs of texts, with the same weights."""
    texts = [(i, t or "") for i, t in rows if i is not None]
    sets = [neardup.shingles(t) for _, t in texts]
    counts = np.zeros(1 << neardup.COUNTERS, np.int64)
    for t in [t for _, t in texts]:
        np.add.at(counts, neardup.counter(neardup.shingles(t)[0]), 1)
    idf = neardup.log_idf(counts, len(texts))
    parent = {i: i for i, _ in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        if texts[a][1] == texts[b][1] or close(sets[a], sets[b], neardup.similarity(sets[a], sets[b], idf), least):
            x, y = sorted((root(texts[a][0]), root(texts[b][0])))
            parent[y] = x
    return {i: root(i) for i in parent}


def test_driver_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == brute(rows)


def test_groups_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows, n = [], 0
    for size in (40, 2, 3):
        base = [word() for _ in range(200)]
        for _ in range(size):
            text = list(base)
            text[rng.integers(200)] = word()
            rows.append((n := n + 1, " ".join(text)))
    rows += [(100 + k, " ".join(word() for _ in range(60))) for k in range(20)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "one two"), (205, "one"), (206, "w " * 30_000), (207, "w " * 30_001), (None, "one two"), (203, "one two")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, v string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == brute(rows)
    kept = neardup.dedup(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(got.values())) and sum(r.doc_id is None for r in kept) == 1
    assert kept[0].asDict().keys() == {"doc_id", "text", "v"}
    assert neardup.classes(docs.limit(0)).count() == 0


def test_chains_and_groups_at_the_threshold(spark):
    """Texts that are similar to one another but not to the hub of their bucket."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for _ in range(6):
        text = [word() for _ in range(200)]
        for _ in range(25):
            rows.append((len(rows), " ".join(text)))
            for _ in range(4):
                text[rng.integers(200)] = word()
    for _ in range(2):
        base = [word() for _ in range(200)]
        for _ in range(60):
            text = list(base)
            for _ in range(rng.integers(2, 6)):
                text[rng.integers(200)] = word()
            rows.append((len(rows), " ".join(text)))
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == brute(rows)


def test_sampling_estimates_similarity():
    idf = np.zeros(1 << neardup.COUNTERS, np.float32)
    a = neardup.shingles(" ".join(f"w{i}" for i in range(400)))
    b = neardup.shingles(" ".join(f"w{i}" if i % 57 else f"x{i}" for i in range(400)))
    x, y = neardup.samples([a, b], idf)
    assert (x == y).mean() == pytest.approx(neardup.similarity(a, b, idf), abs=0.15)


def test_copies_at_the_threshold_in_a_large_group(spark):
    """Ten words changed far apart in copies of 454: of 500 shingles 400 are shared with the original, just 0.8."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [word() for _ in range(454)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):
        text = list(base)
        for at in range(20, 420, 40):
            text[at] = word()
        rows.append((i, " ".join(text)))
    far = list(base)
    for at in range(20, 440, 10):
        far[at] = word()
    rows.append((99, " ".join(far)))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(30)} | {99: 99}
