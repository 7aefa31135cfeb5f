"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents stand in a shuffled queue (the order of a seeded md5 of the id). The p-th copy of a document (p = 0, 1, 2) has the virtual
finish time (p * size of its source + cumulative size up to it in the queue) / target of its source. All copies, sorted by finish time, form the mix,
which ends where the total budget is used up. The budget is the size of all documents, so every source ends near virtual time 1.

No step holds a source in one task: queues are cut into ranges of the shuffle key, whose sums give the offsets; the global order is cut into ranges of
finish time in the same way, and only the range that holds the end is sorted as a whole. The number of ranges follows the square root of the rows.

Defined results: a null text has size 0 and takes nothing; a null source is one source, last in order; rows that repeat an id are separate documents
(ties go by id, then size); an empty table gives an empty result; other columns are kept unless a result column has their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.llm.common import written

#: Weights of the sources in code point order, repeating, and the most passes over a source.
WEIGHTS = (5, 2, 1)
PASSES = 3
SEED = "mix"
RESULT = ("size", "source_size", "target", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size) with each source's target: shares by weight of the whole, none above passes times its size, the excess shared anew.

    Sharing until none is above ends at one level: target = min(weight * level, cap). With sources in order of cap / weight, the level is the first
    (whole - caps before) / (weights from here) that is no more than the source's own cap / weight.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    levels = (
        sizes.withColumn("weight", w.cast("long"))
        .withColumn("cap", F.col("source_size") * passes)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"])
    )
    return levels.select("source", "source_size", "total", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")).alias("target"))


def ranges(rows: int) -> int:
    """A power of two near four times the square root of the rows: as many ranges as rows in a range, within a small factor."""
    return 1 << max(4, (4 * int(rows**0.5)).bit_length() - 1)


def decisions(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken, upto), one row per document: what the mix takes of it, without its text."""
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(SEED), F.col(id_col).cast("string")).cast("binary")).alias("key"),
    )
    queued = queues(written(sized, "mix-sized"))
    end = end_of_mix(queued)
    taken = F.lit(0) if end is None else sum((F.when(place_of(p) <= end, F.col("size")).otherwise(0) for p in range(PASSES)), F.lit(0))
    return queued.select("id", "source", "size", "source_size", "target", F.when(F.col("target") > 0, taken).otherwise(0).cast("long").alias("taken"), "upto")


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with each document's size, source_size, target and taken. Texts are shuffled once, to meet the decisions; rows alike in id, source and size are numbered on either side."""
    kept = [c for c in docs.columns if c not in RESULT]
    wide = docs.select(F.struct(F.lit(0), *map(F.col, kept)).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    alike = Window.partitionBy("id", "source", "size")
    wide = wide.withColumn("n", F.row_number().over(alike.orderBy(F.lit(0))))
    made = written(decisions(docs, text_col, id_col, source_col), "mix-decisions").withColumn("n", F.row_number().over(alike.orderBy("upto")))
    same = [wide[c].eqNullSafe(made[c]) for c in ("id", "source")] + [wide[c] == made[c] for c in ("size", "n")]
    return wide.join(made, same).select(*(F.col(f"row.{c}").alias(c) for c in kept), *(made[c] for c in RESULT))


def place_of(p: int) -> Column:
    """Where the p-th copy stands in the mix; rows without a target stand nowhere."""
    return F.struct(
        F.try_divide(p * F.col("source_size") + F.col("upto"), F.col("target")).alias("finish"), F.col("source").isNull().alias("none"),
        F.coalesce("source", F.lit("")).alias("source"), F.col("key").alias("key"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.col("size").alias("size"),
    )


def queues(sized: DataFrame) -> DataFrame:
    """Each document with its source's size and target and the cumulative size up to it in its source's queue; written once."""
    bits = ranges(sized.count()).bit_length() - 1
    sized = sized.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    sums = written(sized.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    offsets = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(offsets["source"].alias("s"), F.col("range").alias("r"), "before", "source_size", "target", "total")
    queue = Window.partitionBy("source", "range").orderBy("key", F.col("id").cast("string"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sized.withColumn("within", F.sum("size").over(queue))
    joined = upto.join(offsets, upto["source"].eqNullSafe(offsets["s"]) & (upto["range"] == offsets["r"]))
    return written(joined.select("source", "size", "key", "id", "source_size", "target", "total", (F.col("before") + F.col("within")).alias("upto")), "mix-queued")


def end_of_mix(queued: DataFrame) -> Column | None:
    """The place of the last copy that the budget takes; one row comes to the driver."""
    n = ranges(queued.count())
    copies = queued.filter("target > 0 and size > 0").select("size", "total", F.explode(F.array(*map(place_of, range(PASSES)))).alias("place"))
    copies = copies.withColumn("range", F.least(F.floor(F.col("place.finish") * n), F.lit(2 * n)))  # near 1 the mix ends; what lies beyond 2 is one range
    sums = copies.groupBy("range").agg(F.sum("size").alias("range_size"), F.max("total").alias("total"))
    up_to = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = sums.withColumn("upto", F.sum("range_size").over(up_to)).filter("upto >= total").orderBy("range").first()
    if crossing is None:
        return None
    up_to = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = copies.filter(F.col("range") == crossing.range).withColumn("upto", F.sum("size").over(up_to) + (crossing.upto - crossing.range_size))
    last = inside.filter("upto <= total").agg(F.max("place").alias("end")).first().end
    if last is None:  # no copy of the crossing range fits: the mix ends where the range begins
        return F.struct(*(F.lit(v).alias(c) for c, v in (("finish", crossing.range / n), ("none", False), ("source", ""), ("key", ""), ("id", ""))), F.lit(-1).cast("long").alias("size"))
    return F.struct(*(F.lit(last[c]).cast("long" if c == "size" else {"finish": "double", "none": "boolean"}.get(c, "string")).alias(c) for c in ("finish", "none", "source", "key", "id", "size")))


#: The same mix in DuckDB's SQL, over the view documents.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(concat_ws(':', 'mix', doc_id::VARCHAR)) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
       / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s1),
s3 AS (SELECT *, min(CASE WHEN level <= cap / weight THEN {'r': cap / weight, 'l': level} END) OVER () AS lowest FROM s2),
t AS (SELECT source, source_size, total, least(weight * lowest.l, cap::DOUBLE) AS target FROM s3),
q AS (SELECT d.*, t.source_size, t.target, t.total, (sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id::VARCHAR, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, p, (p * source_size + upto) / target AS finish FROM q, (VALUES (0), (1), (2)) v(p) WHERE target > 0 AND size > 0),
m AS (SELECT doc_id, key, size, sum(size) OVER (ORDER BY finish, source IS NULL, source, key, doc_id::VARCHAR, size ROWS UNBOUNDED PRECEDING) <= total AS fits FROM c),
k AS (SELECT doc_id, size, sum(CASE WHEN fits THEN size ELSE 0 END)::BIGINT AS taken FROM m GROUP BY doc_id, size)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id AND q.size = k.size
"""
