"""Tabular previews: heads, caps, string form, schema and catalog reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import Window as W

from corpuslens.functions.markdown import pad_cells
from corpuslens.limits import DEFAULTS, Limits
from corpuslens.operators.ranking import first_per_group

__all__ = [
    "cap_columns",
    "catalog_preview",
    "head_per_group",
    "head_rows",
    "pad_cells",
    "schema_report",
    "sheet_preview",
    "stringify",
    "tsv_lines",
]


def head_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows in a stated order; runs as a top-k, never as a full sort."""
    return df.orderBy(*order).limit(n)


def cap_columns(df: DataFrame, n: int = DEFAULTS.sheet_cols) -> DataFrame:
    """First ``n`` columns; the others are never read."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[:n]])


def sheet_preview(
    df: DataFrame, order: Sequence[str | Column], limits: Limits = DEFAULTS
) -> DataFrame:
    """Preview of a sheet: the header counts as one of its rows, cells are text, nulls empty."""
    head = head_rows(df, order, min(limits.sheet_rows, limits.data_rows) - 1)
    return stringify(cap_columns(head, limits.sheet_cols))


def _number_text(value: Column) -> Column:
    """A double without exponent and without a trailing ``.0``."""
    shortest = value.cast("string")
    large = shortest.try_cast("decimal(38,16)").cast("string")
    small = shortest.try_cast("decimal(38,37)").cast("string")
    plain = (
        F.when(F.abs(value) >= 1e7, F.coalesce(large, shortest))
        .when((F.abs(value) < 1e-3) & (value != 0), F.coalesce(small, shortest))
        .otherwise(shortest)
    )
    trimmed = F.when(
        F.contains(plain, F.lit(".")) & ~F.contains(plain, F.lit("E")),
        F.regexp_replace(plain, r"\.?0+\z", ""),
    ).otherwise(plain)
    return (
        F.when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(trimmed)
    )


def _cell_text(field: ST.StructField, null_as: str) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, ST.BinaryType):
        text = F.format_string("<blob %d bytes>", F.length(value))
        text = F.when(value.isNotNull(), text)
    elif isinstance(field.dataType, ST.FloatType | ST.DoubleType):
        text = _number_text(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(null_as))


def stringify(df: DataFrame, null_as: str = "") -> DataFrame:
    """Every column as text: nulls as ``null_as``, binary as its size, numbers in plain form."""
    return df.select(*[_cell_text(f, null_as).alias(f.name) for f in df.schema.fields])


def schema_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, ordinal, column_name, type, n_rows)`` of named tables.

    Row counts come from one aggregate per table, which reads no column.
    """

    def one(name: str, df: DataFrame) -> DataFrame:
        fields = F.array(
            *[
                F.struct(
                    F.lit(i).cast("bigint").alias("ordinal"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("type"),
                )
                for i, f in enumerate(df.schema.fields, start=1)
            ]
        )
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
        return counted.select(F.lit(name).alias("table_name"), "n_rows", F.inline(fields))

    reports = [one(name, df) for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, reports).select(
        "table_name", "ordinal", "column_name", "type", "n_rows"
    )


def tsv_lines(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """``(part, *order, line)``: the header (part 0) and every row (part 1) as tab-joined text.

    Sorting by ``part`` and the order columns gives the file; the rows themselves are not moved.
    """
    cells = [_cell_text(f, "") for f in df.schema.fields]
    rows = df.select(
        F.lit(1).alias("part"), *[F.col(c) for c in order], F.concat_ws("\t", *cells).alias("line")
    )
    nothing = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order]
    header = df.sparkSession.range(1).select(
        F.lit(0).alias("part"), *nothing, F.lit("\t".join(df.columns)).alias("line")
    )
    return header.unionByName(rows)


def head_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int
) -> DataFrame:
    """First ``n`` rows of every group with ``row_no``, ``more_rows`` and the ``note`` text.

    The rank filter keeps at most ``n`` rows per group and task before the shuffle, and the totals
    are counted before they are shuffled, so a hot group never lands in one task.
    """
    ranked = first_per_group(df, group, order, n, "row_no")
    totals = df.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(
        F.count(F.lit(1)).alias("_total")
    )
    # Null-safe, so that rows without a group keep theirs.
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    more = F.greatest(F.col("_total") - n, F.lit(0))
    return (
        ranked.join(totals, same)
        .drop(*[f"_{c}" for c in group])
        .withColumn("more_rows", more)
        .withColumn(
            "note",
            F.when(
                F.col("more_rows") > 0,
                F.concat(F.lit("… "), F.col("more_rows").cast("string"), F.lit(" more row(s)")),
            ),
        )
        .drop("_total")
    )


def table_preview(df: DataFrame, name: str, n: int, order: Sequence[str] = ()) -> DataFrame:
    """``(table_name, row_no, cells)``: first ``n`` rows of a table as text, nulls as ``NULL``."""
    head = head_rows(df, order, n) if order else df.limit(n)
    key = [F.col(c) for c in order] or [F.monotonically_increasing_id()]
    cells = F.array(*[_cell_text(f, "NULL") for f in df.schema.fields])
    window = W.partitionBy("table_name").orderBy(*[f"_k{i}" for i in range(len(key))])
    return head.select(
        F.lit(name).alias("table_name"), cells.alias("cells"), *[k.alias(f"_k{i}") for i, k in enumerate(key)]
    ).select("table_name", F.row_number().over(window).cast("bigint").alias("row_no"), "cells")


def catalog_preview(
    spark: SparkSession,
    pattern: str = "*",
    db: str | None = None,
    order: Mapping[str, Sequence[str]] | None = None,
    limits: Limits = DEFAULTS,
) -> DataFrame:
    """Preview of every table of a catalog: ``(table_name, columns, row_no, cells)``.

    ``order`` may state sort columns per table; without it the first rows found are taken.
    """
    n = min(limits.data_rows, limits.database_rows)
    names = sorted(t.name for t in spark.catalog.listTables(db, pattern))
    if not names:
        raise ValueError(f"no table matches {pattern!r}")
    previews = []
    for name in names:
        df = spark.table(f"{db}.{name}" if db else name)
        preview = table_preview(df, name, n, (order or {}).get(name, ()))
        previews.append(preview.withColumn("columns", F.lit(", ".join(df.columns))))
    return reduce(DataFrame.unionByName, previews).select(
        "table_name", "columns", "row_no", "cells"
    )
