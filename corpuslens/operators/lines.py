"""Line, piece, page and hex rows of texts. All narrow: positions come from arrays, not windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import mail as ML
from corpuslens.functions import text as T
from corpuslens.functions.detect import first_bytes
from corpuslens.operators.ranking import first_per_group
from corpuslens.session import last_key_wins


def number_lines(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, line_no, text, rendered)``; the number is right-aligned to four places."""
    return (
        df.select(id_col, F.posexplode(T.line_array(F.col(text_col))).alias("pos", "text"))
        .withColumn("line_no", (F.col("pos") + 1).cast("bigint"))
        .select(
            id_col, "line_no", "text", F.format_string("%4d| %s", "line_no", "text").alias("rendered")
        )
    )


def split_pages(
    df: DataFrame, id_col: str = "id", text_col: str = "text", sep: str = "\f"
) -> DataFrame:
    """``(id, page_no, text)`` between form feeds, trimmed."""
    return df.select(
        id_col, F.posexplode(T.page_array(F.col(text_col), sep)).alias("pos", "text")
    ).select(id_col, (F.col("pos") + 1).cast("bigint").alias("page_no"), "text")


def wrap_lines(
    df: DataFrame, width: int = 80, id_col: str = "id", text_col: str = "text"
) -> DataFrame:
    """``(id, row_no, line_no, piece_no, text)``: visual lines of ``width`` columns.

    ``row_no`` counts visual lines from 1 within an id.
    """
    pieces = F.posexplode(T.visual_line_array(F.col(text_col), width)).alias("pos", "piece")
    return df.select(id_col, pieces).select(
        id_col,
        (F.col("pos") + 1).cast("bigint").alias("row_no"),
        "piece.line_no",
        "piece.piece_no",
        "piece.text",
    )


def paginate(
    df: DataFrame,
    page_lines: int = 23,
    width: int = 80,
    id_col: str = "id",
    text_col: str = "text",
) -> DataFrame:
    """Visual lines with their page: ``page_no = (row_no - 1) div page_lines + 1``."""
    return wrap_lines(df, width, id_col, text_col).withColumn(
        "page_no", F.floor((F.col("row_no") - 1) / page_lines).cast("bigint") + 1
    )


def page_counts(
    df: DataFrame,
    page_lines: int = 23,
    width: int = 80,
    id_col: str = "id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_lines, n_pages)``, computed per row without exploding."""
    lines = T.visual_line_count(F.col(text_col), width)
    return df.select(id_col, lines.alias("n_lines")).withColumn(
        "n_pages", F.ceil(F.col("n_lines") / page_lines).cast("bigint")
    )


def hex_dump(
    df: DataFrame,
    cols: int = 16,
    max_bytes: int = 65536,
    id_col: str = "id",
    content_col: str = "content",
) -> DataFrame:
    """``(id, offset, line)``: offset, hex pairs and printable form of every ``cols`` bytes."""
    lines = T.hex_line_array(first_bytes(F.col(content_col), max_bytes), cols)
    return df.select(id_col, F.posexplode(lines).alias("pos", "line")).select(
        id_col, (F.col("pos").cast("bigint") * cols).alias("offset"), "line"
    )


def ini_rows(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, section, key, value)`` of ini texts."""
    return df.select(id_col, F.inline(T.ini_entries(F.col(text_col))))


@last_key_wins
def json_rows(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, text, error)``: JSON in canonical form, the last of repeated keys kept; else the raw text and
    an error."""
    found = df.select(id_col, F.col(text_col).alias("_raw"), T.json_canonical(F.col(text_col)).alias("_json"))
    return found.select(
        id_col,
        F.coalesce("_json", "_raw").alias("text"),
        F.when(F.col("_json").isNull(), "invalid json").alias("error"),
    )


@last_key_wins
def notebook_cells(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, cell_no, cell_type, text, error)``; without cells one row with the raw text."""
    raw = F.col(text_col)

    # The row without cells is made inside the array; beside the generator, the text would be
    # parsed again for every cell.
    def without_cells(error: Column) -> Column:
        return F.struct(
            F.lit(None).cast("bigint").alias("cell_no"),
            F.lit(None).cast("string").alias("cell_type"),
            raw.alias("text"),
            error.alias("error"),
        )

    def rows(cells: Column) -> Column:
        numbered = F.transform(
            cells,
            lambda cell, i: F.struct(
                (i + 1).cast("bigint").alias("cell_no"),
                cell["cell_type"].alias("cell_type"),
                cell["text"].alias("text"),
                F.lit(None).cast("string").alias("error"),
            ),
        )
        error = F.when(T.json_value(raw).isNull(), "invalid json")
        return F.coalesce(numbered, F.array(without_cells(error)))

    return df.select(id_col, F.inline(T.let(T.notebook_cells(raw), rows)))


def join_slides(
    df: DataFrame,
    order: str,
    id_col: str = "id",
    text_col: str = "text",
    titled: bool = False,
    max_chars: int = 0,
) -> DataFrame:
    """``(id, text)``: slides of an id in order, joined, and cut to ``max_chars`` characters if
    given.

    The whole text of an id is one value, as long as its slides. With a limit, every joint adds at least as many characters as its separator, so slides beyond
    ``max_chars / separator + 1`` cannot reach the result. Only that many are kept per id, already
    before the shuffle, which bounds every group exactly.
    """
    joint = 17 if titled else len(T.SLIDE_BREAK)
    if max_chars:
        most = max_chars // joint + 2
        df = first_per_group(df.select(id_col, order, text_col), [id_col], [order], most, "_rank")
    slides = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text_col).alias("_t"))))
    return df.groupBy(id_col).agg(
        T.truncate_chars(
            T.join_slide_array(F.transform(slides, lambda s: s["_t"]), titled), max_chars
        ).alias("text")
    )


def email_rows(df: DataFrame, id_col: str = "id", raw_col: str = "raw") -> DataFrame:
    """``(id, sender, recipient, subject, body, error)`` of raw messages."""
    return df.select(id_col, ML.email_fields(F.col(raw_col)).alias("m")).select(id_col, "m.*")
