import math
import re
from collections import Counter, defaultdict

import pytest
import regex

from factgraph.llm import linededup


def brute(rows):
    def tokens(line):
        return tuple("<*>" if re.search("[0-9@]", w) and not regex.search(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]", w) else w for w in re.split(r"[\t-\r ]+", line.strip("\t\n\v\f\r ")))

    def fixed(t):
        return [w for w in t if w != "<*>"]

    def need(t):
        chars = sum(map(len, fixed(t)))
        return 2 if chars >= 100 else 3 if len(t) >= 3 and len(fixed(t)) >= 2 or chars >= 12 else 20

    at, leaves = defaultdict(list), defaultdict(set)
    for n, (i, text) in enumerate(rows):
        for p, line in enumerate(text.split("\n") if text is not None else []):
            t = tokens(line)
            if sum(map(len, fixed(t))) >= 4:
                at[t].append((i is not None, i, n, p))
                leaves[len(t), t[:2]].add(t)
    shapes = defaultdict(list)
    for leaf, kinds in leaves.items():
        if len(kinds) >= 3:
            kinds = [t for t in kinds if len(fixed(t)) >= 4]
            seen = Counter((j, w) for t in kinds for j, w in enumerate(t) if w != "<*>")
            for t in kinds:
                shape = tuple(w if seen[j, w] >= 3 else "<*>" for j, w in enumerate(t))
                if len(fixed(shape)) < len(fixed(t)) and len(fixed(shape)) >= max(4, math.ceil(len(t) * 0.8)):
                    shapes[leaf, shape].append(t)
    groups = []
    for kinds in shapes.values():
        places = [x for t in kinds for x in at[t]]
        if len({x[2] for x in places}) >= 3:
            groups.append(places)
            for t in kinds:
                del at[t]
    groups += [places for t, places in at.items() if len({x[2] for x in places}) >= need(t)]
    gone = set()
    for places in groups:
        first = min((x[0], x[1] or 0, x[3]) for x in places)
        gone |= {(x[2], x[3]) for x in places if (x[0], x[1] or 0, x[3]) != first}
    return sorted(
        (i if i is not None else -1, None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (n, p) not in gone), 0 if text is None else len(text.split("\n")), sum(g[0] == n for g in gone))
        for n, (i, text) in enumerate(rows)
    )


def test_as_brute_force(spark, monkeypatch):
    common, page = "Licensed under the license.", "Page {} of the report"
    rows = [(i, f"own line number a{'bcdefghij'[i % 9]} z{i}\n{common}\n{page.format(i)}\n\nshort x\n{common}") for i in range(1, 30)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "1 2 3\n4 5 6"), (54, "1 2 3"), (55, "7 8 9"), (56, "word " * 40_000 + "\n" + common), (None, f"nobody has this id\n{common}")]
    rows += [(70, "twice the same row\nand more of it")] * 3
    rows += [(80 + k, f"Posted by {name} in the daily news\nlist\n" + "long passage " * 9) for k, name in enumerate(["Alice", "Bob", "Carol"])]
    rows += [(90, "\n".join(f"An item called {x} in one list only" for x in ("ab", "cd", "ef"))), (91, "长" * 60), (92, "长" * 60), (93, "短句")]
    rows += [(60 + k, f"This long line was sent on to {name} by the desk of the daily news") for k, name in enumerate(["Alice", "Bob", "Carol"])]
    rows += [(63 + k, f"This long {name} was sent on to everyone by the desk of the daily news") for k, name in enumerate(["row", "text", "note"])]
    rows += [(130 + k, f"Commit {k}{'0123456789abcdef' * 4} was built here\n第{k}章长行没有空格的一整行文字内容\nที่ {k} บรรทัดนี้{k}ยาว") for k in range(4)]
    rows += [(100 + k, f"Log in\nonly {'pqrstuvwxyzabcdefghijklmnop'[k]} here") for k in range(25)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, lines string, row string")
    for few in (100_000, 0):
        monkeypatch.setattr(linededup, "FEW", few)
        got = linededup.dedup(docs)
        assert got.columns == ["doc_id", "text", "row", "lines", "dropped"]
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.lines, r.dropped) for r in got.collect()) == brute(rows)
    assert linededup.dedup(docs.limit(0)).count() == 0


def test_a_field_may_be_a_word(spark):
    docs = spark.createDataFrame([(i, f"Posted by {w} in the daily news") for i, w in enumerate(["Alice", "Bob", "Carol", "Dan"])] + [(9, "Posted by Eve on some other day")], "doc_id long, text string")
    assert sorted((r.doc_id, r.dropped) for r in linededup.dedup(docs).collect()) == [(0, 0), (1, 1), (2, 1), (3, 1), (9, 0)]


def test_a_field_at_the_third_place_of_a_long_line(spark):
    docs = spark.createDataFrame([(i, f"This long {w} was sent on to everyone by the desk of the daily news") for i, w in enumerate(["row", "text", "note"])] + [(9, "This long way was sent on to no one by the desk of another paper")], "doc_id long, text string")
    assert sorted((r.doc_id, r.dropped) for r in linededup.dedup(docs).collect()) == [(0, 0), (1, 1), (2, 1), (9, 0)]


def test_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted((r[0], r[1], r[2], r[3]) for r in con.execute(linededup.ORACLE_SQL).fetchall())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = linededup.dedup(docs, keep=["doc_id", "text"])
    assert sorted(tuple(r) for r in got.select("doc_id", "text", "lines", "dropped").collect()) == want
