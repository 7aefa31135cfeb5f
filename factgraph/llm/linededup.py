"""Line dedup by a log-template tree, with DataFrame functions only.

A line's tokens are parsed to a fixed depth: their number, then the LEADING first of them, then a leaf that holds templates. Tokens with a digit or an @
are variable fields from the start and become <*>, at every level, whatever their length; but not those with a character of a script without spaces,
where a token may be a whole line. Within a leaf the lines that differ are generalised by position: a token stays if at least CONSTANT different lines of the leaf have it at
its place, and becomes a field otherwise. Where this gives a template of at least LEAST_FIXED constant tokens, FIXED of all, that is found in GENERAL_DOCS
documents, it is the line's template; else the line as it is (with its masked tokens) is. So a field may be any word, and lines meet in a
template only if all its constant tokens agree. Only leaves that can hold such a template are generalised: two lines of one template differ in its fields
alone, so if the tokens behind the leading ones are cut to one stretch more than it may have fields, the lines share a stretch; leaves in which no two lines
do are left out, and nothing is lost by that, since a template that a single line has recurs as that line does.

A template that is found in enough documents recurs: it stays where it is found first, in the lowest document, and all its other lines are dropped. How
many are enough depends on what is constant in it: 2 documents from LONG characters on; 3 for lines of 3 tokens with 2 constant ones, or of LINE constant
characters; SHORT_DOCS for shorter lines of at least SHORT constant characters. Lines with less in them stay.

Lines travel as 64-bit hashes of their leaf and template, and with a 32-bit hash of each token. Counting combines before the shuffle, so a line that fills
a third of the corpus is one row a task, and only one line of each kind is generalised. Recurring
templates, leaves and constants are broadcast where they are counted and few, and joined by their hash otherwise, where large partitions can be split.

Defined results: null and empty texts stay as they are; a text whose lines all go is empty (whole rows can be left out by the caller: dropped = lines);
rows that repeat id and text count as documents each and keep the same lines; a null id is the lowest; an empty table gives an empty result; other
columns are kept unless a result column has their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import written

LEADING = 2
CONSTANT = 3
LEAST_FIXED, FIXED, GENERAL_DOCS = 4, 0.8, 3
LONG, LINE, SHORT = 100, 12, 4
LONG_DOCS, LINE_DOCS, SHORT_DOCS = 2, 3, 20
#: Rows that are few enough to be broadcast: a row takes about 60 bytes.
FEW = 100_000
GAP = r"[\x09\x0B-\x0D\x20]+"
VARIABLE = "[0-9@]"
#: Scripts that set no spaces between words.
SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
UNSPACED = "[" + "".join(rf"\p{{Is{s}}}" for s in SCRIPTS) + "]"
PLACE = ("id", "row", "pos")


def tokens(text: Column) -> Column:
    """The tokens of each line, variable fields as <*>."""

    def masked(words: Column) -> Column:
        return F.transform(words, lambda w: F.when(w.rlike(VARIABLE) & ~w.rlike(UNSPACED), "<*>").otherwise(w))

    return F.transform(F.split(F.regexp_replace(text, GAP, " "), "\n"), lambda line: F.when(line.rlike(VARIABLE), masked(F.split(F.trim(line), " "))).otherwise(F.split(F.trim(line), " ")))


def parsed(rows: DataFrame) -> DataFrame:
    """(id, row, pos, leaf, line, need, parts, lead): each line that may recur; lead marks the first of its equals in its document."""

    def judged(t: Column, i: Column) -> Column:
        masked = F.array_contains(t, "<*>")
        fixed = F.when(masked, F.filter(t, lambda x: x != "<*>")).otherwise(t)
        return F.struct(t.alias("t"), i.alias("pos"), masked.alias("masked"), F.size(fixed).alias("fixed"), F.length(F.array_join(fixed, "")).alias("chars"))

    def placed(x: Column) -> Column:
        t, chars = x["t"], x["chars"]
        need = F.when(chars >= LONG, LONG_DOCS).when((F.size(t) >= 3) & (x["fixed"] >= 2) | (chars >= LINE), LINE_DOCS).otherwise(SHORT_DOCS)
        parts = F.when(x["fixed"] >= LEAST_FIXED, F.when(x["masked"], F.transform(t, lambda w: F.when(w == "<*>", 0).otherwise(F.hash(w)))).otherwise(F.transform(t, lambda w: F.hash(w))))
        key = F.struct(F.xxhash64(F.size(t), F.slice(t, 1, LEADING)).alias("leaf"), F.xxhash64(F.lit("line"), t).alias("line"))
        return F.struct(key.alias("key"), x["pos"].alias("pos"), need.cast("byte").alias("need"), parts.alias("parts"))

    lines = F.filter(F.transform(tokens(F.col("text")), judged), lambda x: x["chars"] >= SHORT)
    sorted_ = rows.select("id", "row", F.sort_array(F.transform(lines, placed)).alias("x"))
    lead = lambda e, i: ((i == 0) | (F.get("x", i - 1)["key"] != e["key"])).cast("int").alias("lead")
    return sorted_.select("id", "row", F.inline(F.transform("x", lambda e, i: F.struct(e["pos"].alias("pos"), e["key"]["leaf"].alias("leaf"), e["key"]["line"].alias("line"), e["need"].alias("need"), e["parts"].alias("parts"), lead(e, i)))))


def few(df: DataFrame) -> DataFrame:
    """df, which is written, with a hint to broadcast it if it is counted and small."""
    return F.broadcast(df) if df.count() <= FEW else df


def least_fixed(size: Column) -> Column:
    """How many constant tokens a template of size tokens has at least."""
    return F.greatest(F.lit(LEAST_FIXED), F.ceil(size * FIXED))


def alike(lines: DataFrame, leaves: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the leaves in which different lines share a stretch of tokens."""
    size = F.size("parts")
    fields = size - least_fixed(size)
    at = lambda k: F.floor(k * (size - LEADING) / (fields + 1)).cast("int")
    stretch = lambda k: F.xxhash64("leaf", k, F.slice("parts", at(k) + LEADING + 1, at(k + 1) - at(k)))
    some = lines.filter(F.col("parts").isNotNull() & (fields >= 1)).join(few(leaves), "leaf", "left_semi")
    cut = some.select("line", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), fields), stretch)).alias("stretch"))
    shared = cut.groupBy("stretch").agg(F.min("line").alias("line"), F.max("line").alias("other")).filter("line < other").select("line").distinct()
    shared = written(shared, "lines-shared")
    return written(found.join(few(shared), "line", "left_semi").select("leaf").distinct(), "lines-alike")


def generalised(lines: DataFrame, found: DataFrame) -> DataFrame | None:
    """(line, first) of the lines whose generalised template recurs, first being where that is found first."""
    leaves = written(found.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CONSTANT).select("leaf"), "lines-leaves")
    if leaves.isEmpty():
        return None
    leaves = alike(lines, leaves, found)
    if leaves.isEmpty():
        return None
    kinds = lines.filter("parts is not null").join(few(leaves), "leaf", "left_semi").groupBy("leaf", "line").agg(F.any_value("parts").alias("parts"))
    kinds = written(kinds, "lines-kinds")
    words = kinds.select("leaf", "line", F.posexplode("parts").alias("at", "word")).filter("word <> 0")
    constant = words.groupBy("leaf", "at", "word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CONSTANT).select("leaf", "at", "word")
    constant = written(constant, "lines-constant")
    kept = words.join(few(constant), ["leaf", "at", "word"]).groupBy("leaf", "line").agg(F.bit_xor(F.xxhash64("at", "word")).alias("shape"), F.count(F.lit(1)).alias("fixed"))
    size, solid = F.size("parts"), F.size(F.filter("parts", lambda w: w != 0))
    shaped = kinds.join(kept, ["leaf", "line"]).filter((F.col("fixed") < solid) & (F.col("fixed") >= least_fixed(size)))
    shaped = written(shaped.select("leaf", "line", "shape", "fixed"), "lines-shaped")
    if shaped.isEmpty():
        return None
    shaped = few(shaped)
    template = ["leaf", "shape", "fixed"]
    met = lines.drop("leaf").join(shaped, "line").groupBy(*template, *PLACE).agg(F.count(F.lit(1)).alias("n"))  # n: rows alike
    met = met.groupBy(*template, "id", "row").agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
    recur = met.groupBy(*template).agg(F.sum("n").alias("n"), F.min(F.struct(*PLACE)).alias("first")).filter(F.col("n") >= GENERAL_DOCS)
    return written(shaped.join(recur, template).select("line", "first"), "lines-general")


def recurring(lines: DataFrame) -> DataFrame:
    """(line, first) of all lines whose template recurs."""
    found = written(lines.groupBy("leaf", "line").agg(F.sum("lead").alias("n"), F.max("need").alias("need"), F.min(F.struct(*PLACE)).alias("first")), "lines-found")
    same = found.filter("n >= need").select("line", "first")
    general = generalised(lines, found)
    if general is not None:
        same = general.unionByName(same.join(general, "line", "left_anti"))
    return written(same, "lines-recurring")


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns to keep of it) with the text without dropped lines, and the numbers of lines and of dropped lines."""
    shown = [c for c in (docs.columns if keep is None else keep) if c not in ("lines", "dropped")]
    kept = [c for c in shown if c != text_col]
    rows = docs.select(F.struct(F.lit(0), *map(F.col, kept)).alias("kept"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("row", F.xxhash64(F.col("id").cast("string"), "text"))
    lines = written(parsed(rows), "lines-parsed")
    gone = lines.join(few(recurring(lines)), "line").filter(~F.struct(*PLACE).eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("id").alias("gone_id"), F.col("row").alias("gone_row")).agg(F.collect_set("pos").alias("gone"))
    rows = rows.join(gone, (F.col("row") == F.col("gone_row")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    split = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    return rows.select(
        *(left.alias(c) if c == text_col else F.col(f"kept.{c}").alias(c) for c in shown),
        *([] if text_col in shown else [left.alias(text_col)]),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("dropped"),
    )


#: The same dedup in DuckDB's SQL, over the view documents; lines and tokens are compared as they are, not by hash.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
l AS (SELECT n, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
t AS (SELECT n, doc_id, pos, list_transform(string_split(trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g')), ' '),
                                            lambda w: CASE WHEN regexp_matches(w, '[0-9@]') AND NOT regexp_matches(w, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]') THEN '<*>' ELSE w END) AS t FROM l),
f AS (SELECT *, list_filter(t, lambda w: w <> '<*>') AS fixed FROM t),
c AS (SELECT *, length(array_to_string(fixed, '')) AS chars, {'n': len(t), 'lead': t[1:2]} AS leaf FROM f),
k AS (SELECT *, CASE WHEN chars >= 100 THEN 2 WHEN len(t) >= 3 AND len(fixed) >= 2 OR chars >= 12 THEN 3 ELSE 20 END AS need FROM c WHERE chars >= 4),
found AS (SELECT t, any_value(leaf) AS leaf, any_value(fixed) AS fixed, any_value(need) AS need, count(DISTINCT n) AS docs, min({'d': doc_id, 'p': pos}) AS lowest FROM k GROUP BY t),
several AS (SELECT leaf FROM found GROUP BY leaf HAVING count(*) >= 3),
words AS (SELECT leaf, t, unnest(t) AS word, generate_subscripts(t, 1) AS place FROM found SEMI JOIN several USING (leaf) WHERE len(fixed) >= 4),
constant AS (SELECT leaf, place, word FROM words WHERE word <> '<*>' GROUP BY leaf, place, word HAVING count(*) >= 3),
shaped AS (SELECT leaf, t, list({'at': place, 'word': word} ORDER BY place) AS shape FROM words JOIN constant USING (leaf, place, word) GROUP BY leaf, t
           HAVING count(*) < len(list_filter(t, lambda w: w <> '<*>')) AND count(*) >= greatest(4, ceil(len(t) * 0.8))),
general AS (SELECT leaf, shape, min({'d': doc_id, 'p': pos}) AS lowest FROM k JOIN shaped USING (leaf, t) GROUP BY leaf, shape HAVING count(DISTINCT n) >= 3),
r AS (SELECT t, lowest FROM shaped JOIN general USING (leaf, shape)
      UNION ALL SELECT t, lowest FROM found WHERE docs >= need AND t NOT IN (SELECT t FROM shaped JOIN general USING (leaf, shape))),
g AS (SELECT k.n, k.pos FROM k JOIN r USING (t) WHERE NOT (k.doc_id = lowest.d AND k.pos = lowest.p)),
s AS (SELECT l.n, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text, count(*) AS lines, count(g.pos) AS dropped
      FROM l LEFT JOIN g ON l.n = g.n AND l.pos = g.pos GROUP BY l.n)
SELECT d.doc_id, s.text, coalesce(s.lines, 0)::BIGINT AS lines, coalesce(s.dropped, 0)::BIGINT AS dropped FROM d LEFT JOIN s USING (n)
"""
