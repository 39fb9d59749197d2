"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propcube.llm import (bpe, chat_format, crf_langid, exact_dedup, fill_middle, itq_dedup, jaccard_join, license_scan, quality_cnn,
                          source_mix, substring_dedup, topk_search, whitening)
from propcube.llm.common import read
from propcube.llm.oracle import oracle_sql as oracle_sql

QueryFn = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """Where the public tokenizer description lies (never copied here)."""
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op2_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_langid.identify(read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), digest_all=True)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), k=4, percent=85)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents")).drop("source")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    saying = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(saying).alias("content"))
        for role in ("user", "assistant")]).alias("messages"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = chat_format.canonical(rows, "conv_id").unionByName(chat_format.canonical(probe, "conv_id"))
    return chat_format.digests(chat_format.formatted(turns))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(read(spark, sf_dir, "documents"))


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(read(spark, sf_dir, "documents")))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), k=4)


def queries() -> dict[str, QueryFn]:
    return {f.__name__: f for f in (op1_license_scan, op2_crf_langid, op3_bpe, op4_itq_dedup, op5_exact_dedup, op6_jaccard_join, op7_source_mix,
                                   op8_chat_format, op9_substring_dedup, op10_quality_cnn, op11_fill_middle,
                                   op12_topk_search, op13_whitening)}
