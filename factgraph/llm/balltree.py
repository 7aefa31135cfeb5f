"""Centroid clustering by ball-tree filtering: whole balls of vectors go to one centroid wherever the triangle inequality allows it.

Vectors are scaled to integers. Each task packs its vectors into metric trees of at most TREE_ROWS; a ball of a tree keeps its centre, its radius, its
count and its integer sum, and a leaf its vectors. The trees are written once. A round streams them past the centroids: from the top of a tree down, a
ball whose radius is less than half of what a centroid lies nearer to its centre than all others is that centroid's as a whole, and only its count and sum
are taken; otherwise the centroids that can be nearest to no vector of it are left out, and the search descends, at last to a leaf's vectors, which are
compared exactly. Each task gives a count and a sum per centroid, so that a round moves that much only, whatever the number of vectors.

Everything that is returned is exact: balls are decided with a margin for the rounding of their centres and radii, and all else is integer arithmetic.

Defined results: vectors of another length, that are null, or that hold null or non-finite components take no part; rows that repeat an id, and rows without
one, count as vectors of their own; the first centroids are drawn by the hash of the id ('' for none), ties by the smaller vector; fewer vectors than
centroids give fewer centroids; equal distances go to the smaller number; an empty centroid stays where it is; an empty table gives no rows; other columns
play no part. A scaled component beyond 2^27 is an error, since squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import written
from factgraph.llm.topk import usable

DIM = 64
SCALE = 64
CENTROIDS, ROUNDS = 16, 3
SEED = "1"
TREE_ROWS, LEAF = 8192, 32
MOST = 1 << 27
#: A tree: its vectors' ids and components, leaf by leaf; and of each ball, parents first, where its vectors begin and end, its children or -1, its centre, radius and sum.
TREE = "ids array<long>, vectors binary, spans binary, children binary, centers binary, radii binary, sums binary"


@dataclass(frozen=True)
class BallTree:
    ids: pa.Array
    vectors: np.ndarray
    spans: np.ndarray
    children: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    sums: np.ndarray

    @classmethod
    def built(cls, ids: pa.Array, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        """Balls are halved along the widest of their dimensions until LEAF vectors are left, or only copies of one."""
        order = np.arange(len(vectors))
        spans, children, centers, radii, sums = [], [], [], [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = vectors[order[a:b]]
            node = len(spans)
            if parent >= 0:
                children[parent][side] = node
            total = part.sum(axis=0)
            center = total / (b - a)
            away = part - center
            spans.append((a, b))
            children.append([-1, -1])
            centers.append(center)
            radii.append(np.sqrt(np.einsum("ij,ij->i", away, away).max()))
            sums.append(total)
            width = part.max(axis=0) - part.min(axis=0)
            if b - a > leaf and width.any():
                m = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, int(width.argmax())], m)]
                todo += [(a, a + m, node, 0), (a + m, b, node, 1)]
        return cls(ids.take(pa.array(order)), vectors[order], np.array(spans), np.array(children), np.array(centers), np.array(radii), np.array(sums))

    def row(self) -> list[pa.Array]:
        blobs = [self.vectors.astype("<i4"), self.spans.astype("<i4"), self.children.astype("<i4"), self.centers.astype("<f8"), self.radii.astype("<f8"), self.sums.astype("<i8")]
        return [pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), self.ids), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)]

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int, dim: int) -> BallTree:
        kinds = (("<i4", dim), ("<i4", 2), ("<i4", 2), ("<f8", dim), ("<f8", None), ("<i8", dim))
        blobs = [np.frombuffer(batch.column(k + 1)[i].as_py(), dtype=t) for k, (t, _) in enumerate(kinds)]
        return cls(batch.column(0)[i].values, *(x.reshape(-1, n) if n else x for x, (_, n) in zip(blobs, kinds, strict=True)))

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int | None, np.ndarray | None]]:
        """(node, a, b's) parts of the tree: balls that are one centroid's as a whole, as (node, centroid, None), and leaves with the centroid of each vector, as (node, -1, them)."""
        slack = 1e-9 * (1 + float(np.abs(centroids).max()) + float(np.abs(self.centers).max())) * np.sqrt(centroids.shape[1])
        todo = [(0, np.arange(len(centroids)))]
        while todo:
            node, those = todo.pop()
            away = centroids[those] - self.centers[node]
            far = np.sqrt(np.einsum("ij,ij->i", away, away))
            reach = far.min() + 2 * (self.radii[node] + slack)
            those = those[far <= reach]  # strictly farther centroids are nearest to no vector of the ball
            if len(those) == 1:
                yield node, int(those[0]), None
            elif self.children[node][0] >= 0:
                todo += [(int(child), those) for child in self.children[node]]
            else:
                a, b = self.spans[node]
                yield node, -1, those[squared(self.vectors[a:b], centroids[those]).argmin(axis=1)]  # the first of equals, and those ascend


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids, in 64-bit integers."""
    away = vectors.astype(np.int64)[:, None, :] - centroids[None, :, :]
    return np.einsum("ijk,ijk->ij", away, away)


def trees(vectors: DataFrame, dim: int, tree_rows: int) -> DataFrame:
    """The vectors (id, v) as trees, each of what one task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column("id") for b in held])
            flat = np.concatenate([b.column("v").flatten().to_numpy() for b in held])
            held.clear()
            return pa.RecordBatch.from_arrays(BallTree.built(ids, flat.reshape(-1, dim)).row(), TREE.replace(",", "").split()[::2])

        for batch in batches:
            while batch.num_rows:
                room = tree_rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == tree_rows:
                    yield tree()
        if held:
            yield tree()

    return vectors.mapInArrow(run, TREE)


def sums(grown: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(count, sum) of each centroid's vectors; both exact, and of a fixed size whatever the number of vectors."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, dtype=object)
        for batch in batches:
            for i in range(batch.num_rows):
                t = BallTree.read(batch, i, dim)
                part = np.zeros(centroids.shape, np.int64)
                for node, one, each in t.assigned(centroids):
                    a, b = t.spans[node]
                    if each is None:
                        count[one] += b - a
                        part[one] += t.sums[node]
                    else:
                        count += np.bincount(each, minlength=len(centroids))
                        np.add.at(part, each, t.vectors[a:b])
                total += part
        some = np.nonzero(count)[0]
        rows = [(int(c), int(count[c]), [str(x) for x in total[c]]) for c in some]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["cluster", "n", "total"])

    parts = grown.mapInArrow(run, "cluster int, n long, total array<string>")
    at = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in at.orderBy("cluster", "at").collect():
        found.setdefault(r.cluster, (r.n, []))[1].append(int(r.x))
    return found


def nearest(grown: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of each vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = BallTree.read(batch, i, dim)
                cluster = np.empty(len(t.vectors), np.int32)
                for node, one, each in t.assigned(centroids):
                    a, b = t.spans[node]
                    cluster[a:b] = one if each is None else each
                away = t.vectors.astype(np.int64) - centroids[cluster]
                yield pa.RecordBatch.from_arrays([t.ids, pa.array(cluster), pa.array(np.einsum("ij,ij->i", away, away))], ["id", "cluster", "distance"])

    return grown.mapInArrow(run, "id long, cluster int, distance long")


def clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: str = SEED, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of each vector that takes part."""
    spark = vectors.sparkSession
    scaled: Column = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    beyond = F.exists(F.col(vector_col), lambda x: F.abs(x.cast("double") * scale) > MOST)
    v = F.when(beyond, F.raise_error(F.lit(f"a component beyond {MOST} / {scale} has no exact squared distance"))).otherwise(scaled)
    kept = vectors.filter(usable(F.col(vector_col)) & (F.size(vector_col) == dim)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<long>").alias("v"))
    drawn = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "v").limit(k).collect()
    centroids = np.array([r.v for r in drawn], dtype=np.int64).reshape(-1, dim)
    if not drawn:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    grown = written(trees(kept, dim, tree_rows), "balltree-trees")
    for _ in range(rounds):
        for c, (n, total) in sums(grown, centroids).items():
            centroids[c] = [x // n for x in total]
    found = written(nearest(grown, centroids), "balltree-nearest")
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    shown = lambda c: (c, inertia[c], sum(inertia.values()), centroids[c].tolist(), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
    of = spark.createDataFrame([shown(c) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")  # a row a centroid
    return found.join(F.broadcast(of), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def oracle_sql() -> str:
    """The same in DuckDB's SQL, over the view embeddings, every vector compared with every centroid."""
    away = lambda v, c: f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: ({v}[i] - {c}[i]) * ({v}[i] - {c}[i])))::BIGINT"
    text = f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS cluster, v AS c FROM e QUALIFY cluster < {CENTROIDS})"""
    for n in range(ROUNDS + 1):
        text += f""",
d{n} AS MATERIALIZED (SELECT r, vec_id, v, cluster, c, distance FROM (SELECT *, {away("v", "c")} AS distance FROM e, c{n}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)"""
        if n < ROUNDS:
            text += f""",
s{n} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS k FROM d{n}, range(1, {DIM + 1}) AS t(i) GROUP BY cluster, i),
m{n} AS (SELECT cluster, list((CASE WHEN s % k < 0 THEN (s - (s % k + k)) / k ELSE (s - s % k) / k END)::BIGINT ORDER BY i) AS c FROM s{n} GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))"""
    return text + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM d{ROUNDS}"""
