"""Helpers the operators of this subpackage share: staging, ASCII lower case, positions, ranks."""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.plans.storage import work_dir

SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 256  # elements of an array summed in one go


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage is cut and lost executors
    cost nothing, as the files belong to none of them."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let executors delete the shuffles of jobs that are done: they do so when the driver collects its
    garbage, which may be after the next ones have filled the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc32_fold(key: Column, parts: int) -> Column:
    """``crc32(key as text) mod parts``: a fold that any engine can recompute."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)).cast("int")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a lambda variable that holds ``value``. A lambda computes an expression from outside
    again for every element, so arrays that its body reads are bound first."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(values: Column) -> Column:
    """For each element of an integer array the sum of those before it, in linear time.

    Sums run over blocks of ``BLOCK`` elements first and then over the blocks, so that no growing
    array is copied once per element of a long input.
    """

    def run(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            xs,
            start,
            lambda a, x: F.struct(
                (a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")
            ),
            lambda a: a["out"],
        )

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def by_block(wide: Column) -> Column:
        count = F.ceil(F.size(wide) / F.lit(BLOCK)).cast("int")
        blocks = F.when(
            F.size(wide) > 0,
            F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(wide, b * BLOCK + 1, BLOCK)),
        ).otherwise(F.array().cast("array<array<bigint>>"))

        def place(cut: Column) -> Column:
            starts = run(F.transform(cut, total))
            return F.flatten(F.zip_with(cut, starts, lambda xs, s: F.transform(run(xs), lambda x: x + s)))

        return bound(blocks, place)

    return bound(F.transform(values, lambda x: x.cast("bigint")), by_block)


def pieces(
    text: Column, pattern: str | Column, measure: Callable[[Column], Column] = F.length
) -> Column:
    """Matches of a pattern as ``array<struct<start, end, piece, before, after>>``, end exclusive.

    Places are in code points, or in what ``measure`` counts. The gaps between matches and the
    matches themselves alternate, so starts are running sums over both; ``before`` and ``after``
    are the gaps on either side. ``pattern`` never matches an empty text.
    """
    regex = pattern if isinstance(pattern, Column) else F.lit(pattern)

    def zipped(found: Column, gaps: Column) -> Column:
        count = F.size(found)
        return F.arrays_zip(
            found.alias("hit"),
            F.slice(sums_before(F.transform(gaps, measure)), F.lit(1), count).alias("g"),
            sums_before(F.transform(found, measure)).alias("h"),
            F.slice(gaps, F.lit(1), count).alias("before"),
            F.slice(gaps, F.lit(2), count).alias("after"),
        )

    def located(found: Column) -> Column:
        return F.transform(
            bound(F.split(text, regex, -1), lambda gaps: zipped(found, gaps)),
            lambda z: F.struct(
                (z["g"] + z["h"] + measure(z["before"])).alias("start"),
                (z["g"] + z["h"] + measure(z["before"]) + measure(z["hit"])).alias("end"),
                z["hit"].alias("piece"),
                z["before"].alias("before"),
                z["after"].alias("after"),
            ),
        )

    return bound(F.regexp_extract_all(text, regex, F.lit(0)), located)


def placed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], salt: Column, add: str | None = None
) -> DataFrame:
    """Rows with ``place``: how many rows (or how much of ``add``) of the same keys come before.

    A key may hold most rows, so it is never sorted in one task: rows are ordered by ``salt`` (a
    bounded number of values, in the order of ``order``) and then by ``order`` inside a salt; one
    row per key and salt carries the totals of the salts before. ``df`` is read twice: stage it.
    """
    value = F.col(add) if add else F.lit(1)
    salted = df.withColumn("_salt", salt)
    totals = salted.groupBy(*keys, "_salt").agg(F.sum(value.cast("bigint")).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = W.partitionBy(*keys, "_salt").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = salted.withColumn("_local", F.coalesce(F.sum(value.cast("bigint")).over(inside), F.lit(0)))
    return (
        local.join(offsets, [*keys, "_salt"])
        .withColumn("place", F.col("_local") + F.col("_before"))
        .drop("_salt", "_local", "_before")
    )
