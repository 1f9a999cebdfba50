"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

Targets come from filling sources in proportion to their weights until a source stands at its cap.
Every source's documents are shuffled and laid end to end; this stream is cut into blocks of equal
words. Slots of the mix are van der Corput points mapped through the sources' cumulative shares;
the r-th slot of a source takes the r-th block of its stream, which starts again after its end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.llm.common import SPACE, placed, staged

BITS = 40  # of a point
CELLS = 4096  # of [0, 1), for finding a point's source by an equality join
SALTS = 64


def word_count(text: Column) -> Column:
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+"))
    return words.cast("bigint")


def van_der_corput(i: Column) -> Column:
    """Point ``i`` of the sequence in base 2: the bits of ``i`` mirrored behind the point."""
    mirrored = F.rpad(F.reverse(F.bin(i)), BITS, "0")
    return F.conv(mirrored, 2, 10).cast("double") / F.lit(float(2**BITS))


def source_targets(
    sizes: DataFrame, weights: Sequence[int], share: float, repeats: int
) -> DataFrame:
    """``(src, source_size, weight, target)`` from ``(src, source_size)``, one row per source.

    Sources in order weigh ``weights`` in turn. A source is full when the common level reaches its
    cap divided by its weight, so the level is found by sorting sources by that quotient.
    """
    turn = F.pmod(F.row_number().over(W.orderBy("src")) - 1, F.lit(len(weights))).cast("int")
    caps = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn)).withColumn(
        "cap", F.col("source_size") * repeats
    )
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), "src")
    all_rows = W.partitionBy()
    filled = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("cap").over(filled), F.lit(0))
    level = caps.withColumn("level", left / F.sum("weight").over(rest))
    open_ = F.col("cap") / F.col("weight") > F.col("level")
    final = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "src", "level"))).over(all_rows)
    return level.withColumn("final", final["level"]).select(
        "src",
        "source_size",
        "weight",
        F.when(F.col("final").isNull(), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("final")))
        .alias("target"),
    )


def mix_schedule(rows: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """``(slot, src, rid, first_word, words)``: what the mix takes, in the order of its slots.

    ``rows``: ``(rid, src, size, h)``; ``targets``: as :func:`source_targets` gives.
    """
    spark = rows.sparkSession
    quota = targets.select(
        "src", "source_size", F.floor(F.col("target") + 0.5).cast("bigint").alias("quota")
    ).withColumn("n_slots", F.ceil(F.col("quota") / block).cast("bigint"))
    shares = W.orderBy("src").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    quota = staged(
        quota.withColumn("hi", F.sum("n_slots").over(shares) / F.sum("n_slots").over(every))
        .withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("src")), F.lit(0.0)))
        .withColumn("all_slots", F.sum("n_slots").over(every)),
        "mix-quota",
    )
    total = quota.agg(F.max("all_slots")).first()[0] or 0
    cells = quota.filter("n_slots > 0").withColumn(
        "cell",
        F.explode(
            F.sequence(
                F.floor(F.col("lo") * CELLS).cast("int"),
                F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"),
            )
        ),
    )
    points = spark.range(total).select(
        F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("v")
    )
    points = points.withColumn("cell", F.floor(F.col("v") * CELLS).cast("int"))
    drawn = staged(
        points.join(cells.select("cell", "src", "lo", "hi"), "cell")
        .filter("v >= lo and v < hi")
        .select("slot", "src"),
        "mix-slots",
    )
    chunk = F.floor(F.col("slot") / max(1, -(-total // SALTS)))
    ranked = placed(drawn, ["src"], ["slot"], chunk).withColumnRenamed("place", "rank")
    have = drawn.groupBy("src").agg(F.count(F.lit(1)).alias("have"))
    short = (
        quota.join(have, "src", "left")
        .withColumn("have", F.coalesce("have", F.lit(0).cast("bigint")))
        .filter("have < n_slots")
        .select("src", F.explode(F.sequence(F.col("have"), F.col("n_slots") - 1)).alias("rank"))
        .withColumn("slot", F.col("rank") + total)  # after all points; ties go by source
    )
    slots = ranked.select("src", "rank", "slot").unionByName(short.select("src", "rank", "slot"))
    salt = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
    laid = placed(rows, ["src"], ["h", "rid"], salt, add="size").filter("size > 0")
    passes = (
        laid.join(quota.select("src", "source_size", "quota"), "src")
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.floor(
            (F.col("quota") - 1) / F.col("source_size")).cast("int"))))
        .withColumn("from", F.col("place") + F.col("turn") * F.col("source_size"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota")))
        .filter(F.col("from") < F.col("to"))
    )
    cut = passes.withColumn(
        "rank",
        F.explode(
            F.sequence(
                F.floor(F.col("from") / block).cast("bigint"),
                F.floor((F.col("to") - 1) / block).cast("bigint"),
            )
        ),
    ).select(
        "src",
        "rid",
        "rank",
        (F.greatest("from", F.col("rank") * block) - F.col("from")).alias("first_word"),
        (F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block)).alias(
            "words"
        ),
    )
    return cut.join(slots, ["src", "rank"]).select("slot", "src", "rid", "first_word", "words")


def mix_documents(
    df: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    block: int = 1024,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """What the mix takes of every row: ``(key, size, source_size, target, taken)``.

    ``size`` counts the words of the text; ``target`` is the source's share of ``share`` times all
    words, at most ``repeats`` times its size; ``taken`` is the row's words in the schedule, at
    most ``repeats`` times its size. A source takes its target rounded to whole words. Null text
    has no words; a null source is a source of its own, last in order; rows without words take
    none; repeated rows are rows of their own; an empty table gives no rows. Shuffling orders rows
    by the MD5 of their key, so reruns agree. Other columns are ignored.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(key).alias("id"),
        F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("src"),
        word_count(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("h"),
    )
    rows = staged(rows, "mix-rows")
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes, weights, share, repeats), "mix-targets")
    schedule = mix_schedule(rows.select("rid", "src", "size", "h"), targets, block)
    taken = schedule.groupBy("rid").agg(F.sum("words").alias("taken"))
    return (
        rows.join(staged(taken, "mix-taken"), "rid", "left")
        .join(targets, "src")
        .select(
            F.col("id").alias(key),
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        )
    )
