import hashlib
import re

import pytest
from pyspark.sql import functions as F

from factgraph.llm import infill, queries


def brute(key, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

TEXTS = ["", None, "a", "\n", "one\ntwo\nthree", "ends\n", "\n\n\n", "é😀 ß\r\nx y\x0bz\n\x00", "has <P> in\nit", "<\nP>\nS>\n<M\n>", "x" * 700_000, "long line \n" * 60_000, "a\n" + "<" * 50 + "\n>", "中文\n日本語"]


def test_as_brute_force(spark):
    rows = [(i, t, "n", "output") for i, t in enumerate(TEXTS * 5)] + [(1, "twice\ntold\n", "n", "o"), (None, "no\nid\n", "n", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, other string").repartition(3)
    done = infill.transform(df).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted(map(str, ((r.doc_id, r.other, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in done.collect())))
    assert got == sorted(map(str, ((i, o, *brute("" if i is None else i, t), t or "") for i, t, _, o in rows)))
    assert infill.transform(df.limit(0)).count() == 0 and {"psm", "spm", "plain"} == {r.form for r in done.select("form").distinct().collect()}


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_pieces_join(piece):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    splitter = Split(Regex(infill.UNIT), "isolated")
    for t in TEXTS:
        t = (t or "")[:400]
        want = [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", t)]
        assert infill.ends(t, splitter, piece).tolist() == want


def test_rate_of_zero_keeps_texts_plain(spark):
    df = spark.createDataFrame([(i, "a\nb\n") for i in range(20)], "doc_id long, text string")
    assert {tuple(r) for r in infill.transform(df, rate=0).select("form", "output").collect()} == {("plain", "a\nb\n")}


def test_query(spark):
    data = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.op12_fill_in_middle(spark, data).collect()))
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((i, n, form, p, m, sha(out), sha(t or "")) for i, t in rows for n, form, p, m, out in [brute(i, t)])
    assert got == want
