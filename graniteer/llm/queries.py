"""The queries of this subpackage: op1 to op10 and the pipeline, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spread import spread
from . import ann, crf, langid, minhash, mixing, pieces, quality_rules, sharding, sql, suffixes, toxicity
from .util import crc_of_id

#: Target shares of the mixture; a source that is not named has share 1.
SHARES = {"src0": 4}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    held = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(held, "doc_id") if table == "documents" else held


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, SHARES).select("doc_id", "source", "block", "place", "slot", "release", "deadline")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _read(spark, sf_dir, "documents"), F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0
    model = crf.fit(docs, _read(spark, sf_dir, "labels"), ~held)
    return crf.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_rows(_read(spark, sf_dir, "documents"), pieces.Codec.load()).select("doc_id", "n_tokens", "token_ids", "round_trip")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(_read(spark, sf_dir, "documents"), width=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32")
    )
    placed = sharding.shard_rows(docs, "doc_id", 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _read(spark, sf_dir, "documents"), F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1
    out = langid.identify(docs, langid.fit(docs, ~held))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _read(spark, sf_dir, "documents"), F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_quality_rules, op2_mixing, op3_quality_classifier, op4_suffix_dedup, op5_nearest, op6_pieces, op7_minhash, op8_sharding, op9_language_id, op10_toxicity)
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": sql.op1(), "op2_mixing": sql.op2(SHARES), "op4_suffix_dedup": sql.op4(), "op7_minhash": sql.op7(), "op8_sharding": sql.op8()}
