import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import topk


def brute(rows, k=10):
    v = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, x in sorted({i: x for i, x in v if i % 100 == 0}.items()):
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in v if i != q and len(x) == len(y))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def searched(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 300)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist(), "x") for i in range(1000)]
    rows += [(2000 + i, rows[500][1], None) for i in range(400)]  # copies: ties beyond k
    assert searched(spark, rows) == brute([r[:2] for r in rows])


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], "a"), (1, [1.0, -2.0], None), (1, [1.0, -2.0], None), (2, None, "b"), (3, [float("nan"), 1.0], "c"), (4, [None, 1.0], "d"), (5, [], "e"), (None, [1.0, 1.0], "f"), (100, [float("inf"), 0.0], "g"), (200, [0.0, 0.0], "h")]
    assert searched(spark, rows) == brute([r[:2] for r in rows])
    assert searched(spark, []) == []
    assert searched(spark, [(0, [1.0], "a")]) == []


def test_products_beyond_64_bits_are_ordered(spark, monkeypatch):
    """Against Python's integers: products near the end of 64 bits, and ones far beyond 64 bits that cancel or lie outside the k best."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 2.0**19.3], "a") for i in range(150)]
    assert searched(spark, rows) == brute([r[:2] for r in rows])
    rows = [(0, [3e38, 1.0, 0.0], "a")] + [(i, [0.0, i / 7, 1e30], "b") for i in range(1, 30)] + [(100, [0.0, 1.0, 0.0], "c"), (50, [-3e38, 5.0, 0.0], "d"), (51, [-1e38, 5.0, 0.0], "d")]
    assert searched(spark, rows) == brute([r[:2] for r in rows])


def test_a_score_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="leaves 64 bits"):
        searched(spark, [(0, [3e38, 1.0], "a"), (1, [3e38, 0.0], "b")])
