"""A training-corpus pipeline over the table documents: filter, dedup lines, dedup documents, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result and hands it to the next. A stage needs the columns
doc_id, text and source; line_dedup counts n_chars anew where docs has it.

Defined results: a null text scores as the empty one, has no lines to lose, is a near duplicate of the empty text, and takes no place in a mix, so it
does not reach encoding; very long texts go through whole; rows that repeat an id stay apart in the quality filter and line dedup, and are one document
from near dedup on, which keeps the least text of them; rows without an id stay, and rows without a source are one source; an empty table gives an
empty result in every stage; all other columns come out as they went in, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import bpe, linededup, mixing, neardup, quality
from factgraph.llm.common import made, released, table, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LEAST_QUALITY = 0.3


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, source and text, with all other columns in one, so that none can clash with an operator's."""
    return docs.select("doc_id", "source", "text", F.struct(F.lit(0), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "source", "text"))).alias("others"))


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df with the columns of docs."""
    return df.select(*(F.col(c) if c in ("doc_id", "source", "text") else F.col(f"others.`{c}`").alias(c) for c in docs.columns))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the compression classifier scores at LEAST_QUALITY or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return unpacked(quality.score(packed(docs), model).filter(F.col("score") >= LEAST_QUALITY), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the repeats of recurring lines, n_chars anew; those that have no line left go."""
    clean = linededup.dedup(packed(docs)).filter("dropped = 0 or dropped < lines")
    clean = unpacked(clean, docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return unpacked(neardup.dedup(packed(docs)), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    mixed = mixing.mix(packed(docs)).filter("taken > 0")
    copies = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return unpacked(mixed.withColumn("copy", copies), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, packed as little-endian unsigned 32-bit integers, their number and their digest."""
    done = bpe.encode_decode(packed(docs), TOKENIZER, keep=["doc_id", "source"])
    return done.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]
#: SQL can express neither the compression classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage has put into the shared folder goes when its result is written, so one stage's folders are there at a time."""
    docs = table(spark, sf_dir, "documents")
    since = len(made)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            released(spark, since, keep=docs)
    return docs
