"""What the text operators share: reading tables, shared folders, and hashing of rows to folds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folders that this process has made in the shared folder and not yet released.
made: list[str] = []


def released(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Deletes the folders that were made after the first since ones, but for those that keep reads. Only for results that are written: others are still to be read."""
    kept = set() if keep is None else {f[: f.rfind("/")] for f in keep.inputFiles()}
    jvm = spark._jvm.org.apache.hadoop.fs
    for path in made[since:]:
        at = jvm.Path(path)
        if not any(k.rstrip("/").endswith(at.toUri().getPath()) for k in kept):
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            made.remove(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local session may leave that unset: elsewhere a folder of the driver's is no shared one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if spark.conf.get("spark.checkpoint.dir", None) is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's files, with its scheme."""
    base = shared_dir(spark)
    base = re.sub(r"^(file:)?/+", "file:///", base)
    made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage, and later stages can lose executors."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5; fold 0 is held out from all training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text_col: str = "text", id_col: str = "doc_id") -> list[tuple[str, int]]:
    """(text, label) of at most per_class rows of each class, none of them of fold 0; in the order of a hash of the id.

    The bound on rows holds before the texts are read: ids are drawn from the labels alone, and only their texts are looked up and brought to the driver.
    Every text comes whole. Where labels of an id conflict, 1 holds; where an id has several texts, the least.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("id")) != 0))
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("at", F.xxhash64("id"))
    drawn = None
    for value in (0, 1):
        some = known.filter(F.col("label") == value).orderBy("at", "id").limit(per_class)
        drawn = some if drawn is None else drawn.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    found = texts.join(F.broadcast(drawn), "id").groupBy("id", "at", "label").agg(F.min("text").alias("text")).toPandas()
    found = found.sort_values(["at", "id"])
    return list(zip(found["text"].tolist(), found["label"].tolist(), strict=True))
