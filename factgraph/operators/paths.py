"""The shortest directed path, by levels.

A path's key is the list of its steps' orders (type, origin, kind and name of the end, id). Of equally long paths the one with the least key is found,
which is what a first-in-first-out search over ordered neighbours finds. A level keeps one row per new asset: its rank among the level's, in the order of
their paths, and the step that leads to it from an asset of the level before; so a row does not grow with the path. Ranks come from a distributed sort.
Edges are written once in buckets of their start, so that a level moves what it has reached and not the edges, and only edges that lead on meet the assets
that they end at. Levels are written as they are found; the path is walked back from the goal, a row of each level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.plans.materialize import bucketed, written


def ahead_of(edges: DataFrame, reached: DataFrame, visited: DataFrame) -> DataFrame:
    """The edges from what is reached to what is not yet visited."""
    return edges.join(reached.select(F.col("id").alias("from_id"), "rank"), "from_id").join(visited.withColumnRenamed("id", "to_id"), "to_id", "left_anti")


def shortest_path(relationships: DataFrame, assets: DataFrame, start: int, goal: int) -> DataFrame:
    """(step, from_id, to_id, type, origin, kind, name, relationship_id): no rows from an asset to itself; LookupError where the goal can't be reached."""
    spark = relationships.sparkSession
    schema = "step long, from_id long, to_id long, type string, origin string, kind string, name string, relationship_id long"
    if start == goal:
        return spark.createDataFrame([], schema)
    edges = bucketed(relationships.select("id", "from_id", "to_id", "type", "origin"), "path-edges", "from_id")
    ends = assets.select(F.col("id").alias("to_id"), "kind", "name")
    reached = spark.createDataFrame([(start, 0)], "id long, rank long")
    visited, levels = reached.select("id"), []
    while True:
        ahead = ahead_of(edges, reached, visited).join(ends, "to_id").withColumn("step", F.struct("type", "origin", "kind", "name", "id", "from_id", "to_id"))
        ahead = ahead.groupBy(F.col("to_id").alias("id")).agg(F.min(F.struct("rank", "step")).alias("first"))
        reached = written(ahead.orderBy("first").select("id", F.monotonically_increasing_id().alias("rank"), "first.step"), f"path-{len(levels)}")
        levels.append(reached)
        if not reached.filter(F.col("id") == goal).isEmpty():
            break
        if reached.isEmpty():
            raise LookupError(f"no directed path from {start} to {goal}")
        visited = visited.unionByName(reached.select("id"))
        if len(levels) % 16 == 0:  # a long search reads few folders
            visited = written(visited, f"visited-{len(levels)}")
    at, found = goal, []
    for n in range(len(levels), 0, -1):
        s = levels[n - 1].filter(F.col("id") == at).select("step.*").first()
        found.append((n, s.from_id, s.to_id, s.type, s.origin, s.kind, s.name, s.id))
        at = s.from_id
    return spark.createDataFrame(found[::-1], schema)
