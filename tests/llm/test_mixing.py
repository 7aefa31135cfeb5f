from collections import defaultdict
from hashlib import md5

import pytest

from factgraph.llm import mixing


def brute(rows, weights=(5, 2, 1), passes=3):
    """The mix by its definition, in plain Python."""
    size = lambda text: len([w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w])
    docs = [(i, s, size(t)) for i, t, s in rows]
    total = sum(d[2] for d in docs)
    of = defaultdict(int)
    for _, s, n in docs:
        of[s] += n
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, total, set(names)
    while True:  # share, hold those above their cap there, share again
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if weight[s] * level > passes * of[s]}
        if not above:
            break
        for s in above:
            target[s] = passes * of[s]
            left -= target[s]
        open_ -= above
    target |= {s: weight[s] * level for s in open_}
    copies, upto = [], defaultdict(int)
    for i, s, n in sorted(docs, key=lambda d: (md5(f"mix:{d[0]}".encode()).hexdigest(), str(d[0]), d[2])):
        upto[s] += n
        copies += [((p * of[s] + upto[s]) / target[s], s is None, s or "", md5(f"mix:{i}".encode()).hexdigest(), str(i), n) for p in range(passes) if target[s] > 0 and n]
    taken, used = defaultdict(int), 0
    for c in sorted(copies):
        used += c[-1]
        if used > total:
            break
        taken[c[4], c[5]] += c[-1]
    return {(i, n): (of[s], pytest.approx(target[s]), taken[str(i), n]) for i, s, n in docs}


CASES = {
    "uneven": [(i, "w " * (1 + i * 7 % 50), f"s{i % 3 if i % 5 else 0}") for i in range(200)],
    "null source, null and empty texts": [(1, "a b c", None), (2, None, "x"), (3, "", "y"), (4, "a b c\td", "x"), (5, "q " * 30, "z")],
    "one source": [(i, "w " * i, "s") for i in range(20)],
    "a very long text": [(1, "w " * 400_000, "a"), *((i, "w " * (i * 3), "ab"[i % 2]) for i in range(2, 60))],
    "capped": [(i, "w " * (500 if i > 5 else 2), "a" if i < 3 else "b" if i < 6 else "c") for i in range(40)],
}


@pytest.mark.parametrize("case", CASES)
def test_as_brute_force(spark, case):
    rows = CASES[case]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.size): (r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect()}
    assert got == brute(rows)


def test_empty_ties_and_clashes(spark):
    schema = "doc_id long, text string, source string, size string, end string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "a b", "s", "mine", "e")] * 3 + [(None, "c", "s", None, None)]
    got = mixing.mix(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "source", "end", "size", "source_size", "target", "taken"]
    out = got.collect()
    assert len(out) == 4 and sum(r.taken for r in out) == 7 and {r.target for r in out} == {7.0}
