import hashlib
import math

import duckdb
import numpy as np
import pytest

from factgraph.llm import balltree

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def brute(rows, dim):
    """Each vector compared with each centroid, in Python integers."""
    v = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(v, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:16]
    c = [x for _, x in first]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x: min((away(x, y), k) for k, y in enumerate(c))
    for _ in range(3):
        at = [near(x)[1] for _, x in v]
        for k in range(len(c)):
            own = [x for (_, x), a in zip(v, at, strict=True) if a == k]
            if own:
                c[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    done = [(i, near(x)) for i, x in v]
    whole = sum(d for _, (d, _) in done)
    digest = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((i, k, d, sum(e for _, (e, j) in done if j == k), whole, digest[k]) for i, (d, k) in done), key=str)


def clustered(spark, rows, dim, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in balltree.clusters(df, dim=dim, **kw).drop("centroid").collect()), key=str)


def test_as_brute_force(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(9, 6)) * 20
    rows = [(i, (middles[i % 9] + rng.normal(size=6) * (0.2 if i % 9 else 8)).round(2).tolist(), "x") for i in range(1500)]
    rows += [(5000 + i, rows[7][1], None) for i in range(400)]  # copies
    assert clustered(spark, rows, 6, tree_rows=256) == brute([r[:2] for r in rows], 6)


def test_ties_and_lattices(spark):
    """Points of a small lattice lie at equal distances from many centroids."""
    rows = [(i, [i % 3 / 64, i // 3 % 3 / 64, -(i % 2) / 64], "x") for i in range(300)]
    assert clustered(spark, rows, 3, tree_rows=100) == brute([r[:2] for r in rows], 3)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], "a"), (1, [1.0, -2.0], None), (1, [1.0, -2.0], None), (1, [1.0, -2.5], "z"), (2, None, "b"), (3, [float("nan"), 1.0], "c"), (4, [None, 1.0], "d"), (5, [], "e"), (None, [1.0, 1.0], "f"), (6, [float("inf"), 0.0], "g"), (7, [1.0], "h")]
    assert clustered(spark, rows, 2) == brute([r[:2] for r in rows], 2)
    assert clustered(spark, [], 2) == [] and clustered(spark, [(1, [1.0], "a")], 2) == []


def test_large_components(spark):
    rows = [(i, [(-1.0) ** i * 2.0**21, i * 1000.0], "a") for i in range(40)]
    assert clustered(spark, rows, 2) == brute([r[:2] for r in rows], 2)
    with pytest.raises(Exception, match="no exact squared distance"):
        clustered(spark, [(1, [2.0**22, 0.0], "a")], 2)


def test_whole_balls_are_taken():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-5, 5, (500, 8)) + 1000, rng.integers(-5, 5, (500, 8)) - 1000])
    t = balltree.BallTree.built(pa.array(range(1000)), v)
    parts = list(t.assigned(np.array([[990] * 8, [-1010] * 8])))
    assert len(parts) == 2 and sorted(p[1] for p in parts) == [0, 1] and sum(t.spans[p[0]][1] - t.spans[p[0]][0] for p in parts) == 1000


def test_query_as_sql(spark):
    from factgraph.llm import queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op11_ball_tree_clusters"])
    got = queries.op11_ball_tree_clusters(spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall()) and got.count() == 500
