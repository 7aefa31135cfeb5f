"""Cutting lineage: results of loop steps go to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def folder(df: DataFrame, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Only a local session may leave that unset: elsewhere a folder of the driver's is no shared one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="checkpoint-"))
    return re.sub(r"^(file:)?/+", "file:///", sc.getCheckpointDir()).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again."""
    return Grown(df, name).all()


class Grown:
    """A table that grows by rounds: each round's rows are written once, and can be read alone or with all before them by a plan of one size."""

    def __init__(self, df: DataFrame, name: str):
        self.session, self.schema, self.path, self.rounds = df.sparkSession, df.schema, folder(df, name), 0
        self.add(df)

    def add(self, df: DataFrame) -> int:
        """The number of rows that have come."""
        self.rounds += 1
        seen = Observation()
        df.select(*self.schema.names).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/round={self.rounds:05d}")
        self.new = seen.get["n"]
        return self.new

    def last(self) -> DataFrame:
        return self.session.read.schema(self.schema).parquet(f"{self.path}/round={self.rounds:05d}")

    def all(self) -> DataFrame:
        return self.session.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df written once, dealt and sorted by key, and read again: joins on the key move the other side only."""
    path = folder(df, name)
    table = "_".join(path.rsplit("/", 1)[-1].split("-"))
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
