"""The registered queries of the training-data operators: thin projections of each operator onto its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exactdedup, langid, linededup, minhash, mixing, quality, secrets, sharding, wavelet
from .common import table
from .oracles import ORACLES


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Settings(words=3, over=85, under=100))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.equal_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.clean(table(spark, sf_dir, "documents").select("doc_id", "text"), marks=True)
    return cleaned.select(
        "doc_id", "n_removed", "removed_words", F.length("text").cast("long").alias("clean_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"),
    )


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    shown = F.transform("spans", lambda x: x.withField("kind", F.when(x["kind"] == "bare", "live").otherwise(x["kind"])))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(shown).alias("spans"),
        F.size(F.filter("spans", lambda x: x["owned"])).cast("long").alias("n_owned"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_mixing, op3_langid, op4_bpe, op5_secrets, op6_minhash, op7_exact_dedup, op8_wavelet, op9_line_dedup, op10_quality)}


def oracle_sql() -> dict[str, str]:
    """Checksums, regular-expression positions, tokenizers and fitted models are beyond the SQL engine; tests cover those."""
    return dict(ORACLES)
