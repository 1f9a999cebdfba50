"""Sharding by longest processing time: whole groups, largest first, to the least-loaded shard.

Groups are the rows of equal text. Their sizes are counted per size class (the leading
``CLASS_BITS`` bits of the size, so sizes below 4096 are exact and others within 1/2048); there
are at most ``2 ** (CLASS_BITS - 1) * 52`` classes at any input. The heap runs over this histogram,
largest class first, and gives out how many groups of a class each shard gets. Groups then find
their shard by their rank in the class, which is counted without sorting a class in one task.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import placed, staged

CLASS_BITS = 12
SALTS = 64


def size_class(size: Column) -> Column:
    """Size with all but its leading ``CLASS_BITS`` bits cleared."""
    spare = F.greatest(F.lit(0), F.length(F.bin(size)) - CLASS_BITS)
    scale = F.pow(F.lit(2.0), spare).cast("bigint")
    return size - F.pmod(size, scale)


def lpt(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """``(class, count, bytes)`` to ``(class, running counts by shard)`` by the heap.

    Many groups of one size first fill all shards up to a common level, as the heap would; the
    last ones go out one by one.
    """
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for cls, count, total in sorted(classes, reverse=True):
        each, given = total / count, [0] * shards
        if count > 2 * shards and each > 0:
            low, high = min(heap)[0], max(heap)[0] + each * count
            for _ in range(100):
                level = (low + high) / 2
                fits = sum(max(0, int((level - load) / each)) for load, _ in heap)
                low, high = (level, high) if fits <= count else (low, level)
            for k, (load, s) in enumerate(heap):
                given[s] = max(0, int((low - load) / each))
                heap[k] = (load + given[s] * each, s)
            heapq.heapify(heap)
        for _ in range(count - sum(given)):
            load, s = heapq.heappop(heap)
            given[s] += 1
            heapq.heappush(heap, (load + each, s))
        out.append((cls, list(accumulate(given))))
    return out


def shard_documents(
    df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", overhead: int = 8
) -> DataFrame:
    """Every row of ``df`` with its shard and its place there.

    Returns ``(key, size, text_crc32, law, shard, slot, grown_shard)``: size is the UTF-8 bytes of
    the text plus ``overhead``, rows of equal text share a shard, ``slot`` runs from 0 without gaps
    in every shard, ``law`` is ``bytes`` and ``grown_shard`` null. Null text counts as empty and
    belongs to the group of empty texts; repeated rows and null keys are rows like others; an empty
    table gives no rows. Other columns of ``df`` are ignored.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = staged(
        df.select(
            F.col(key).alias("id"),
            (F.length(content) + overhead).cast("bigint").alias("size"),
            F.crc32(content).alias("crc"),
            F.unhex(F.sha2(content, 256)).alias("sha"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("sha").agg(F.sum("size").alias("bytes"))
    groups = staged(groups.withColumn("cls", size_class(F.col("bytes"))), "shard-groups")
    counts = groups.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    plan = lpt([(r["cls"], r["n"], r["b"]) for r in counts.collect()], shards)
    bins = df.sparkSession.createDataFrame(plan, "cls bigint, cums array<bigint>")
    salt = F.pmod(F.xxhash64("sha"), F.lit(SALTS))
    ranked = placed(groups, ["cls"], ["sha"], salt)
    homes = ranked.join(bins, "cls").select(
        "sha",
        F.size(F.filter("cums", lambda c: c <= F.col("place"))).alias("shard"),
    )
    homed = staged(rows.join(staged(homes, "shard-homes"), "sha"), "shard-homed")
    spread = F.pmod(F.xxhash64("id", "sha"), F.lit(SALTS * 16))
    return placed(homed, ["shard"], ["id", "sha"], spread).select(
        F.col("id").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
