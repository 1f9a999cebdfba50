"""Markdown structure of many documents as rows. All narrow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import markdown as M
from corpuslens.functions.text import let, trim_unicode


def md_blocks(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, block_no, type, block)`` in document order."""
    return df.select(
        id_col, F.posexplode(M.blocks(F.col(text_col))).alias("block_no", "block")
    ).select(id_col, "block_no", M.block_type(F.col("block")).alias("type"), "block")


def _blocks_of(df: DataFrame, kinds: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """Blocks of some types, numbered from 1 among themselves."""

    def typed(block: Column) -> Column:
        return M.block_type(block).isin(*kinds)

    return df.select(
        id_col,
        M.link_definitions(F.col(text_col)).alias("_links"),
        F.posexplode(F.filter(M.blocks(F.col(text_col)), typed)).alias("pos", "block"),
    ).select(id_col, "_links", (F.col("pos") + 1).cast("bigint").alias("no"), "block")


def _numbered_fences(blocks: Column) -> Column:
    """``array<struct<block, fence_no>>``: the fences, and all other lines as one block without a
    number."""

    def is_fence(block: Column) -> Column:
        return M.block_type(block) == "fence"

    def numbered(every: Column) -> Column:
        fences = F.transform(
            F.filter(every, is_fence),
            lambda b, i: F.struct(b.alias("block"), (i + 1).cast("bigint").alias("fence_no")),
        )
        outside = F.array_join(F.filter(every, lambda b: ~is_fence(b)), "")
        others = F.array(
            F.struct(outside.alias("block"), F.lit(None).cast("bigint").alias("fence_no"))
        )
        return F.concat(fences, F.filter(others, lambda o: o["block"] != ""))

    return let(blocks, numbered)


def md_lines(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, line_no, text, in_fence, fence_no, lang)``; the marker lines belong to the fence."""
    blocks = df.select(id_col, F.inline(_numbered_fences(M.blocks(F.col(text_col), quotes=False))))
    in_fence = F.col("fence_no").isNotNull()

    # As in md_lists, the language is put into the lines, not computed beside the generator.
    def lines(block: Column) -> Column:
        return let(
            F.when(in_fence, M.fence_lang(block)),
            lambda lang: F.transform(
                M.block_lines(block),
                lambda l: F.struct(
                    l["line_no"].alias("line_no"), l["text"].alias("text"), lang.alias("lang")
                ),
            ),
        )

    return blocks.select(id_col, "fence_no", F.inline(lines(F.col("block")))).select(
        id_col, "line_no", "text", in_fence.alias("in_fence"), "fence_no", "lang"
    )


def md_headings(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, line_no, level, text)`` of headings outside fences, with marks before or lines under
    them, in quotes too; the lines of an underlined heading are joined by spaces."""

    def headings(blocks: Column) -> Column:
        return F.filter(F.transform(blocks, M.heading), lambda h: h.isNotNull())

    links = M.link_definitions(F.col(text_col)).alias("_links")
    found = df.select(id_col, links, F.inline(let(M.blocks(F.col(text_col)), headings)))
    text = M.inline_text(F.col("text"), definitions=F.col("_links"))
    return found.select(id_col, "line_no", "level", text.alias("text"))


def md_code_blocks(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, block_no, lang, code)`` of fences that are not blank and of indented code."""
    block = F.col("block")
    fenced = M.block_type(block) == "fence"
    return (
        _blocks_of(df, ["fence", "code"], id_col, text_col)
        .select(
            id_col,
            F.col("no").alias("block_no"),
            F.when(fenced, M.fence_lang(block)).otherwise("").alias("lang"),
            F.when(fenced, M.fence_code(block)).otherwise(M.indented_code(block)).alias("code"),
        )
        .filter(trim_unicode(F.col("code")) != "")
    )


def md_tables(
    df: DataFrame, max_rows: int = 1000, id_col: str = "id", text_col: str = "text"
) -> DataFrame:
    """``(id, table_no, line_no, headers, aligns, rows, more_rows)``.

    Rows are brought to the width of the header; the first ``max_rows`` are kept and the rest
    counted. A delimiter row whose width differs from the header makes no table.
    """

    def clean(line: Column) -> Column:
        cells = M.table_cells(line)
        return F.transform(
            cells, lambda c: M.inline_text(c, keep_ticks=False, definitions=F.col("_links"))
        )

    def is_table(block: Column) -> Column:
        lines = M.block_lines(block)
        width = F.size(M.table_cells(F.get(lines, F.lit(0))["text"]))
        return (M.block_type(block) == "table") & (
            width == F.size(M.table_cells(F.get(lines, F.lit(1))["text"]))
        )

    tables = df.select(
        id_col,
        M.link_definitions(F.col(text_col)).alias("_links"),
        F.posexplode(F.filter(M.blocks(F.col(text_col)), is_table)).alias("pos", "block"),
    ).select(
        id_col,
        "_links",
        (F.col("pos") + 1).cast("bigint").alias("table_no"),
        M.block_lines(F.col("block")).alias("lines"),
    )
    body = F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0)))
    headers = tables.select(
        id_col,
        "_links",
        "table_no",
        F.get("lines", F.lit(0))["line_no"].alias("line_no"),
        clean(F.get("lines", F.lit(0))["text"]).alias("headers"),
        M.alignments(F.get("lines", F.lit(1))["text"]).alias("aligns"),
        F.slice(body, 1, max_rows).alias("body"),
        F.greatest(F.size("lines") - 2 - max_rows, F.lit(0)).cast("bigint").alias("more_rows"),
    )
    width = F.size("headers")
    return headers.select(
        id_col,
        "table_no",
        "line_no",
        "headers",
        "aligns",
        F.transform("body", lambda l: M.pad_cells(clean(l["text"]), width)).alias("rows"),
        "more_rows",
    )


def md_lists(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, list_no, line_no, depth, ordered, number, text, rendered)``.

    Bullets become ``•``; ordered items count on from the first number of their list; two spaces
    per depth.
    """
    # The first number goes into every chunk inside the array: taken from the block beside the
    # generator, it would be cut out of the whole block again for every item.
    def numbered_chunks(block: Column) -> Column:
        return let(
            M.outer_number(block),
            lambda first: F.transform(
                M.list_items(block),
                lambda chunk, i: F.struct(first.alias("first"), i.alias("pos"), chunk.alias("chunk")),
            ),
        )

    chunks = _blocks_of(df, ["list"], id_col, text_col).select(
        id_col, "_links", F.col("no").alias("list_no"), F.inline(numbered_chunks(F.col("block")))
    )
    items = chunks.select(
        id_col, "_links", "list_no", "first", "pos", F.inline(M.item_tree(F.col("chunk")))
    )
    items = items.withColumn("text", M.inline_text(F.col("text"), definitions=F.col("_links")))
    number = F.when(
        (F.col("depth") == 0) & (F.col("pos") > 0), F.col("first") + F.col("pos")
    ).otherwise(F.col("number"))
    mark = F.when(F.col("ordered"), F.concat(number.cast("string"), F.lit(". "))).otherwise("• ")
    return items.select(
        id_col,
        "list_no",
        "line_no",
        "depth",
        "ordered",
        F.when(F.col("ordered"), number).alias("number"),
        "text",
        F.concat(F.repeat(F.lit("  "), F.col("depth")), mark, F.col("text")).alias("rendered"),
    )
