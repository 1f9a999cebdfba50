"""First rows per group without bringing a hot group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import Window as W

_NOT_HASHED = (ST.MapType, ST.VariantType)


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int, rank: str
) -> DataFrame:
    """Rows ranked 1 to ``n`` in their group, with the rank as a column.

    Up to the group limit of the session (1000 by default) the planner keeps at most ``n`` rows
    per group and task before it shuffles. Beyond, groups are first cut by salt: the first ``n``
    of a group are among the first ``n`` of its salts, so the result is the same. There are as many
    salts as shuffle partitions.
    """
    limit = df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    if n > int(limit):
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, _NOT_HASHED)]
        salt = F.pmod(F.xxhash64(*[f"`{c}`" for c in plain]), F.lit(salts))
        salted = df.withColumn("_salt", salt)
        window = W.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_place", F.row_number().over(window))
            .filter(F.col("_place") <= n)
            .drop("_salt", "_place")
        )
    ranked = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank, ranked.cast("bigint")).filter(F.col(rank) <= n)
