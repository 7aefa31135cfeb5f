"""Running sums and numbers by ranges, against one pass in plain Python."""

import itertools
import random

from factgraph.plans import prefix


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 40), i, rng.randint(0, 9), rng.randint(-5, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, x long, y long").repartition(7)
    got = sorted(tuple(r) for r in prefix.running(df, ["a", "b"], {"x": "sx", "y": "sy"}, 6).collect())
    rows.sort()
    sums = zip(itertools.accumulate(r[2] for r in rows), itertools.accumulate(r[3] for r in rows), strict=True)
    assert got == [(*r, *s) for r, s in zip(rows, sums, strict=True)]
    assert prefix.running(df.limit(0), ["a"], {"x": "sx"}).count() == 0


def test_numbers_are_dense_and_rerun_alike(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc") if i % 9 else None, rng.randint(0, 3), {"k": "v"}) for i in range(2000)]  # many ties
    df = spark.createDataFrame(rows, "a string, b long, m map<string,string>")
    runs = [sorted((r.id, r.a, r.b) for r in prefix.numbered(df.repartition(n), ["a"], partitions=5).collect()) for n in (1, 4)]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == list(range(1, 2001))
    assert [(r[1] or "", r[2]) for r in runs[0]] == sorted((r[0] or "", r[1]) for r in rows)
