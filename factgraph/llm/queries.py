"""The registered queries of this subpackage: each applies its operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import balltree, bpe, idfiles, infill, langid, linededup, media, mixing, neardup, pii, quality, topk, toxicity
from factgraph.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), *mixing.RESULT)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = idfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return idfiles.read(listed).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = media.store(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return media.load(places).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth"
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.transform(table(spark, sf_dir, "documents"), keep=["doc_id"])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = infill.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    languages = langid.fit(docs, F.col("doc_id").isNotNull() & ~held_out)
    return langid.identify(docs, languages, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe_encode_decode, op2_quality, op3_id_files, op4_media_columns, op5_line_dedup, op6_near_duplicates, op7_personal_data, op8_toxicity, op9_exact_top_k, op10_mix_sources, op11_ball_tree_clusters, op12_fill_in_middle, op13_language)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": linededup.ORACLE_SQL, "op9_exact_top_k": topk.ORACLE_SQL, "op10_mix_sources": mixing.ORACLE_SQL, "op11_ball_tree_clusters": balltree.oracle_sql()}
