"""Exact top-k by inner product: a KD-tree per shard, searched best-first with bounds on boxes.

Rows are dealt into shards by a hash of their id. Each shard is split at medians of its widest dimension into leaves with tight boxes. For a query q
and a box, sum(max(q * low, q * high)) bounds every inner product inside; the search takes boxes in the order of their bounds and stops once the best
bound left is below the k-th score. A first pass searches each query in its own shard; the k-th score found there goes along to all other shards,
so that they start with it. Scores are integers, hence exact, and a bound that equals the k-th score is still searched, for the tie.

A shard's vectors come first and are made a tree once; all queries of their length then stream past it, so that a task holds one shard whatever the
number of queries. This is the stated search of a query set against all rows, not a join of rows with rows; each shard returns k rows a query at most,
and the k best of a query are kept before the shuffle as well as after it.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do null ids; inner products need equal lengths, so only
candidates of a query's own length count; a query's own id is no candidate, also where rows repeat it, and its smallest vector asks, the shortest first;
other rows that repeat an id count once each; ties go to the smaller id; fewer candidates than k give fewer rows; other columns play no part. Where products
may leave 64 bits they are made of Python's integers, so that every order is exact; a score to be returned that leaves 64 bits itself is an error.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.llm.common import written

SCALE = 1024
K = 10
LEAF = 64
#: Rows of a shard.
SHARD_ROWS = 20_000
LOWEST = -(2**63) + 1
#: What stands for all scores that leave 64 bits.
LEAST, MOST = -(2**63), 2**63 - 1
RESULT = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


class KdTree:
    """Median splits with tight bounding boxes, in arrays; rows of a leaf are next to each other."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        low, high, spans, children = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = vectors[order[a:b]]
            node = len(low)
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            spans.append((a, b))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = node
            width = high[-1] - low[-1]
            if b - a > leaf and width.any():
                m = (b - a) // 2
                widest = part[:, int(width.argmax())]
                order[a:b] = order[a:b][np.argsort(widest) if widest.dtype == object else np.argpartition(widest, m)]
                todo += [(a, a + m, node, 0), (a + m, b, node, 1)]
        self.low, self.high, self.spans, self.children = np.array(low), np.array(high), spans, children
        self.vectors, self.ids = vectors[order], ids[order]
        self.largest = max(abs(int(self.low[0].min())), abs(int(self.high[0].max())))

    def search(self, query: np.ndarray, own: int, k: int, floor: int) -> list[tuple[int, int]]:
        """At most k (score, -id) that are no worse than floor, best first; LOWEST is no floor."""
        floor = -math.inf if floor == LOWEST else floor
        bounds = inner(self.high, np.maximum(query, 0), self.largest) + inner(self.low, np.minimum(query, 0), self.largest)
        boxes = [(-int(bounds[0]), 0)]
        best: list[tuple[int, int]] = []
        while boxes and -boxes[0][0] >= floor:
            node = heapq.heappop(boxes)[1]
            if self.children[node][0] >= 0:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(boxes, (-int(bounds[child]), child))
                continue
            a, b = self.spans[node]
            scores = inner(self.vectors[a:b], query, self.largest)
            near = np.nonzero((scores >= floor) & (self.ids[a:b] != own))[0]
            for s, i in zip(scores[near].tolist(), self.ids[a:b][near].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                floor = max(floor, best[0][0])
        return sorted(best, reverse=True)


def scaled(column: pa.ListArray) -> np.ndarray:
    """The rows' components times SCALE, rounded down: 64-bit integers, or Python's where those are too small."""
    x = column.flatten().to_numpy().reshape(len(column), -1)
    if not x.size or np.abs(x).max() < 2.0**42:
        return np.floor(x * SCALE).astype(np.int64)
    whole = [int(c) * SCALE if abs(c) >= 2.0**42 else math.floor(c * SCALE) for c in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


def inner(vectors: np.ndarray, query: np.ndarray, largest: int) -> np.ndarray:
    """Inner products of rows whose components are no larger than that."""
    fits = vectors.dtype != object and query.dtype != object and largest * int(np.abs(query).max()) * len(query) < 1 << 62
    return vectors @ query if fits else vectors.astype(object) @ query.astype(object)


def searched(rows: DataFrame, asking: DataFrame, k: int, only_floor: bool) -> DataFrame:
    """Each shard's answers to the queries of (shard, id, v, dim, floor) that are dealt to it: hits, or only the k-th score of each."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            out: list[tuple] = []
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "asks")], axis=1)
            edges = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if at != tuple(keys[a, :2]):
                    at, held, tree = tuple(keys[a, :2]), [], None
                ids, v = batch.column("id")[a:b].to_numpy(), scaled(batch.column("v")[a:b])
                if not keys[a, 2]:
                    held.append((v, ids))
                elif held:
                    tree = tree or KdTree(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    for q, x, floor in zip(ids.tolist(), v, batch.column("floor")[a:b].to_pylist(), strict=True):
                        found = tree.search(x, q, k, floor)
                        if not only_floor:
                            out += [(q, -i, max(LEAST, min(s, MOST))) for s, i in found]
                        elif len(found) == k and found[-1][0] > LOWEST:
                            out.append((q, 0, min(found[-1][0], MOST)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    mine = rows.select("dim", "shard", F.lit(0).alias("asks"), "id", "v", F.lit(LOWEST).alias("floor"))
    dealt = mine.unionByName(asking.select("dim", "shard", F.lit(1).alias("asks"), "id", "v", "floor"))
    return dealt.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks").mapInArrow(search, RESULT)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by inner product of floor(SCALE * x)."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.when(usable(F.col(vector_col)), F.col(vector_col).cast("array<double>")).alias("v"),
    ).filter("v is not null and size(v) > 0 and id is not null")
    rows = written(rows.withColumn("dim", F.size("v")), "topk-rows")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    asks = rows.filter("asks").groupBy("id").agg(F.min(F.struct("dim", "v", "shard")).alias("q")).select("id", "q.*")
    asks = written(asks, "topk-queries")
    first = searched(rows, asks.withColumn("floor", F.lit(LOWEST)), k, only_floor=True).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    asks = asks.drop("shard").join(written(first, "topk-floors"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST)))
    asking = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    hits = written(searched(rows, asking, k, only_floor=False), "topk-hits")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    fits = F.when(F.col("score").isin(LEAST, MOST), F.raise_error(F.lit("a score among the best leaves 64 bits"))).otherwise(F.col("score"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", fits.cast("long").alias("score"))


#: The same search by brute force in DuckDB's SQL, over the view embeddings.
ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
