"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.ann import nearest
from corpuslens.llm.common import staged, table
from corpuslens.llm.compression_rules import judge_texts
from corpuslens.llm.conversation_repair import digests, repair_conversations, repaired_rows
from corpuslens.llm.exact_dedup import dedup_exact
from corpuslens.llm.jaccard_join import link_documents
from corpuslens.llm.license_scan import scan_licenses
from corpuslens.llm.lm_score import score_documents
from corpuslens.llm.mixing import mix_documents
from corpuslens.llm.packing import pack_documents
from corpuslens.llm.pii import find_pii
from corpuslens.llm.quality import classify_quality
from corpuslens.llm.ranked_search import search_ranked
from corpuslens.llm.sharding import shard_documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("found")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a fold of ``conv_id:turn``; nulls become one space."""
    one = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), one) for c in ("conv_id", "turn"))
    fold = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = F.coalesce("role", one), F.coalesce("text", one)
    rows = conversations.select("conv_id", "turn", fold.alias("fold"), role.alias("role"), text.alias("text"))
    fold = F.col("fold")
    text = F.when(fold == 1, "").when(fold == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.filter(fold != 0).select(
        "conv_id",
        "turn",
        F.when(fold == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fold == 3, 2).otherwise(1))).alias("copy"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations")
    rows = damaged(source)
    report = staged(repair_conversations(rows), "repair-report")
    hashed = digests(repaired_rows(rows, report))
    named = source.select(F.col("conv_id").alias("_id")).distinct()
    found = named.join(report, F.col("_id").eqNullSafe(report["conv_id"]), "left").drop("conv_id")
    found = found.join(hashed, F.col("_id").eqNullSafe(hashed["conv_id"]), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        F.col("_id").alias("conv_id"),
        *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_ann,
        op3_exact_dedup,
        op4_quality,
        op5_jaccard_join,
        op6_pii,
        op7_best_fit_packing,
        op8_lm_score,
        op9_mixing,
        op10_sharding,
        op11_ranked_search,
        op12_conversation_repair,
        op13_compression_rules,
    )
}
