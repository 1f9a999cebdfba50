"""A training-data pipeline over ``documents``: filter, deduplicate, mix and pack.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the
last return the columns of ``docs`` as they came, also where extra ones share internal names. Lists of
documents grow with the corpus, so they are joined by sorting at every size and never broadcast. Rows
without a key are never dropped as duplicates; repeated rows share their fate. Empty tables pass
through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import ascii_lower, staged, table
from corpuslens.llm.exact_dedup import dedup_exact
from corpuslens.llm.jaccard_join import link_documents
from corpuslens.llm.mixing import mix_documents
from corpuslens.llm.packing import pack_documents
from corpuslens.llm.quality import keep_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

WORDS, PERCENT = 5, 80  # of a shingle; least similarity of near copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their own labels, does not reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    found = dedup_exact(docs).filter("not kept and doc_id is not null")
    dropped = found.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    same = (docs["doc_id"] == F.col("_id")) & (
        F.sha2(ascii_lower(docs["text"]).cast("binary"), 256) == F.col("_sha")
    )
    return docs.join(staged(dropped, "pipeline-copies").hint("merge"), same, "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal shingles the one with the smallest id."""
    linked = link_documents(docs, words=WORDS, percent=PERCENT).filter("doc_id != component_id")
    dropped = staged(linked.select(F.col("doc_id").alias("_id")).distinct(), "pipeline-near")
    return docs.join(dropped.hint("merge"), docs["doc_id"] == F.col("_id"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. One that is cut by the end of its source's share
    comes whole, so a source may exceed its target by less than a document."""
    plan = mix_documents(docs).filter("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    plan = plan.groupBy(F.col("doc_id").alias("_id")).agg(F.max(copies).alias("_copies"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_key"))
    taken = rows.join(staged(plan, "pipeline-mix").hint("merge"), F.col("_key").eqNullSafe(F.col("_id")))
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Trees, tokens and packing have no SQL form; the tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
