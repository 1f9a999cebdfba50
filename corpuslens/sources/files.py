"""File sources and the preview sink."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import Window as W

from corpuslens.functions.images import image_header
from corpuslens.functions.text import delimited_cells, delimiter_mark, json_value
from corpuslens.limits import DEFAULTS, Limits
from corpuslens.operators.tables import table_preview
from corpuslens.session import last_key_wins

MAX_CONTENT = 2**31 - 1 - 2**20  # a file is one binary value, which cannot be larger


def scan_files(
    spark: SparkSession, paths: str | Sequence[str], glob: str | None = None
) -> DataFrame:
    """``(path, length, modificationTime, content)``, one row per file below ``paths``.

    Without ``content`` in the query the files are listed but not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(list(paths) if not isinstance(paths, str) else paths)


def readable_files(files: DataFrame) -> DataFrame:
    """Files whose content fits one value; the size filter is pushed into the scan, so an oversize
    file is skipped before it is read."""
    return files.filter(F.col("length") <= MAX_CONTENT)


def oversize_files(files: DataFrame) -> DataFrame:
    """``(path, length)`` of the files :func:`readable_files` leaves out; nothing is read."""
    return files.filter(F.col("length") > MAX_CONTENT).select("path", "length")


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file_no, path, line_no, line)``: files in the order given, lines unchanged.

    Files are read in splits, so a file may be of any size. A line's number is its place in its
    split plus the lines of the splits before, which are counted first; only these counts meet the
    lines again.
    """
    source = spark.read.option("lineSep", "\n").text(list(dict.fromkeys(paths)))
    lines = source.select(
        uri_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("line"),
    )
    counts = lines.groupBy("path", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first")
    )
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "path", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    order = spark.createDataFrame(
        [(i, plain_path(p)) for i, p in enumerate(paths, start=1)], "file_no bigint, path string"
    )
    placed = offsets.join(order, "path")
    return lines.join(placed, ["path", "start"]).select(
        "file_no",
        "path",
        (F.col("offset") + F.col("row_id") - F.col("first") + 1).alias("line_no"),
        "line",
    )


def uri_path(uri: Column) -> Column:
    """Path of an encoded file URI (as in ``_metadata.file_path``); see :func:`local_path`."""
    decoded = F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return local_path(F.coalesce(decoded, uri))


def local_path(path: Column) -> Column:
    """Path without a leading ``file:`` scheme, as :func:`plain_path` gives; others stay."""
    return F.regexp_replace(path, r"\Afile:(?://(?=/))?", "")


def plain_path(path: str) -> str:
    """Path without a leading ``file:`` scheme."""
    return re.sub(r"\Afile:(?://(?=/))?", "", path)


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    header: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """``(path, start, row_id, cells)``: records as text cells, ragged rows kept with all cells.

    Files are read in splits, so they may be of any size, also with line breaks inside quotes: see
    :func:`_placed_lines`. Blank lines between records are left out. File order is ``(start,
    row_id)``. With ``header`` the first record of every file is left out; see
    :func:`delimited_headers`. A field is quoted when it starts with a quote; an open quote runs to
    the end of the file, or, without ``multi_line``, of the line.
    """
    lines, firsts = _placed_lines(spark, path, sep, multi_line)
    records = _joined_records(lines)
    if header:
        records = records.join(firsts, ["path", "row_id"], "left_anti")
    cells = delimited_cells(F.regexp_replace("record", r"\r\z", ""), sep)
    return records.select("path", "start", "row_id", cells.alias("cells"))


def delimited_headers(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", multi_line: bool = True
) -> DataFrame:
    """``(path, headers)``: first record of every file that has one; no other record is cut."""
    lines, firsts = _placed_lines(spark, path, sep, multi_line)
    of_first = lines.join(firsts.withColumnRenamed("row_id", "first_id"), ["path", "first_id"], "left_semi")
    cells = delimited_cells(F.regexp_replace("record", r"\r\z", ""), sep)
    return _joined_records(of_first).select("path", cells.alias("headers"))


def _quote_scan(whole: bool):
    """Scan over lines in file order with ``path, start, row_id, from_plain, from_quoted, blank``.

    A split does not know whether it starts inside quotes, so both cases are followed: the case
    before every line, and the line its record starts with (null: one before the split). With
    ``whole`` one row per split comes out, else one per line. Nested, so that it is shipped by value.
    """

    def follow(plain: np.ndarray, quoted: np.ndarray, now: bool) -> np.ndarray:
        """Whether quotes are open after each line, when they are ``now`` before the first."""
        places = np.arange(len(plain))
        fixed = np.maximum.accumulate(np.where(plain == quoted, places, -1))
        flips = np.cumsum(plain & ~quoted)
        since = flips - np.where(fixed >= 0, flips[fixed], 0)
        return np.where(fixed >= 0, plain[fixed], now) ^ (since % 2 == 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, first, filled = None, [False, True], [None, None], None

        def summary() -> pa.RecordBatch:
            values = [*split, *state, *first, filled]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _SPLIT, strict=True)], _SPLIT_NAMES)

        for batch in batches:
            path, start = batch.column("path").to_pylist(), batch.column("start").to_numpy()
            ids = batch.column("row_id").to_numpy()
            flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("from_plain", "from_quoted", "blank")]
            new = np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | np.array([a != b for a, b in zip(path[1:], path)], bool)])
            out: list[list] = [[], [], [], []]
            for at, end in zip(new.tolist(), [*new[1:].tolist(), len(ids)], strict=True):
                if split != (path[at], int(start[at])):
                    if whole and split:
                        yield summary()
                    split, state, first, filled = (path[at], int(start[at])), [False, True], [None, None], None
                plain, quoted, blank = (f[at:end] for f in flags)
                for case in (0, 1):
                    after = follow(plain, quoted, state[case])
                    before = np.r_[state[case], after[:-1]]
                    begun = np.maximum.accumulate(np.where(before, -1, np.arange(len(before))))
                    ids_of = [int(ids[at + k]) if k >= 0 else first[case] for k in begun.tolist()]
                    out[case] += before.tolist()
                    out[2 + case] += ids_of
                    if case == 0 and filled is None:
                        full = np.flatnonzero(~blank | before)
                        filled = ids_of[full[0]] if len(full) else None
                    state[case], first[case] = bool(after[-1]), ids_of[-1]
            if not whole:
                kinds = [pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
                added = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "open0", "open1", "first0", "first1"])
        if whole and split:
            yield summary()

    return scan


_SPLIT_NAMES = ["path", "start", "end0", "end1", "last0", "last1", "filled"]
_SPLIT = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]


def _placed_lines(
    spark: SparkSession, path: str | Sequence[str], sep: str, multi_line: bool
) -> tuple[DataFrame, DataFrame]:
    """Lines ``(path, start, row_id, line, first_id, alone)`` with the line their record starts with, and
    ``(path, row_id)`` of every file's first record.

    Where a record ends depends on the quotes from the start of the file. For every line it is known
    what it makes of either case, open quotes or none; a split sums that up in one row, splits are
    put together per file, and only those that start inside quotes are joined to their lines.
    """
    paths = [path] if isinstance(path, str) else list(path)
    mark = delimiter_mark(sep)
    complete = rf'(?:"(?:[^"]|"")*+"[^{mark}]*+|(?!")[^{mark}]*+){mark}'
    is_open = F.lit(rf'(?s)\A(?:{complete})*+"(?:[^"]|"")*+\z')
    source = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths)
    lines = source.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.rlike("value", is_open).alias("from_plain"),
        F.rlike(F.concat(F.lit('"'), "value"), is_open).alias("from_quoted"),
        F.rlike("value", F.lit(r"\A\r?\z")).alias("blank"),
        F.col("value").alias("line"),
    )
    if not multi_line:
        full = lines.filter(~F.col("blank")).select("path", "start", "row_id", "line")
        in_file = F.min_by("row_id", F.struct("start", "row_id"))
        firsts = full.groupBy("path").agg(in_file.alias("row_id"))
        return full.withColumns({"first_id": F.col("row_id"), "alone": F.lit(True)}), firsts
    splits = lines.drop("line").mapInArrow(
        _quote_scan(True),
        "path string, start bigint, end0 boolean, end1 boolean, last0 bigint, last1 bigint, filled bigint",
    )
    begin = F.struct(
        F.lit(False).alias("open"),
        F.lit(None).cast("bigint").alias("id"),
        F.lit(None).cast("bigint").alias("filled"),
        F.array().cast("array<struct<start:bigint,id:bigint>>").alias("quoted"),
    )

    def put(state: Column, split: Column) -> Column:
        here = F.struct(split["start"].alias("start"), state["id"].alias("id"))
        last = F.when(state["open"], split["last1"]).otherwise(split["last0"])
        return F.struct(
            F.when(state["open"], split["end1"]).otherwise(split["end0"]).alias("open"),
            F.coalesce(last, state["id"]).alias("id"),
            F.coalesce(state["filled"], split["filled"]).alias("filled"),
            F.when(state["open"], F.concat(state["quoted"], F.array(here))).otherwise(state["quoted"]).alias("quoted"),
        )

    in_order = F.array_sort(F.collect_list(F.struct("start", "end0", "end1", "last0", "last1", "filled")))
    files = splits.groupBy("path").agg(F.aggregate(in_order, begin, put).alias("f"))
    firsts = files.select("path", F.col("f.filled").alias("row_id")).filter("row_id IS NOT NULL")
    quoted = files.select(F.col("path").alias("_path"), F.inline("f.quoted").alias("_start", "_id"))

    known = list(lines.schema.fields) + list(
        ST.StructType.fromDDL("open0 boolean, open1 boolean, first0 bigint, first1 bigint").fields
    )
    scanned = lines.mapInArrow(_quote_scan(False), ST.StructType(known))
    placed = scanned.join(
        quoted, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")), "left"
    )
    inside = F.col("_start").isNotNull()
    is_quoted = F.when(inside, F.col("open1")).otherwise(F.col("open0"))
    stays_open = F.when(is_quoted, F.col("from_quoted")).otherwise(F.col("from_plain"))
    rows = placed.select(
        "path",
        "start",
        "row_id",
        "line",
        F.coalesce(F.when(inside, F.col("first1")).otherwise(F.col("first0")), "_id").alias("first_id"),
        (~is_quoted & ~stays_open).alias("alone"),
        (F.col("blank") & ~is_quoted).alias("_blank"),
    )
    return rows.filter(~F.col("_blank")).drop("_blank"), firsts


def _joined_records(lines: DataFrame) -> DataFrame:
    """``(path, start, row_id, record)``: only records of several lines are brought together."""
    alone = lines.filter("alone").select("path", "start", "row_id", F.col("line").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("start", "row_id", "line")))
    together = lines.filter(~F.col("alone")).groupBy("path", "first_id").agg(pieces.alias("p"))
    several = together.select(
        "path",
        F.get("p", F.lit(0))["start"].alias("start"),
        F.col("first_id").alias("row_id"),
        F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("record"),
    )
    return alone.unionByName(several)


@last_key_wins
def read_json_docs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, value variant, error, raw)``: one JSON value per file; a bad file gives an error
    row with its raw text, a file too large for one value an error row that is never read."""
    paths = path if isinstance(path, str) else list(path)
    docs = spark.read.text(paths, wholetext=True, recursiveFileLookup=True)
    parsed = docs.filter(F.col("_metadata.file_size") <= MAX_CONTENT).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("raw"),
        json_value(F.col("value")).alias("value"),
    )
    bad = F.col("value").isNull()
    read = parsed.select(
        "path",
        "value",
        F.when(bad, "invalid json").alias("error"),
        F.when(bad, F.col("raw")).alias("raw"),
    )
    # The condition on the file's data leaves the other files out when the scan is planned.
    too_large = scan_files(spark, paths).filter(F.col("_metadata.file_size") > MAX_CONTENT)
    skipped = oversize_files(too_large).select(
        "path",
        F.lit(None).cast("variant").alias("value"),
        F.lit("file too large").alias("error"),
        F.lit(None).cast("string").alias("raw"),
    )
    return read.unionByName(skipped)


def read_parquet_preview(
    spark: SparkSession,
    path: str,
    n: int | None = None,
    order: Sequence[str] = (),
    limits: Limits = DEFAULTS,
) -> DataFrame:
    """``(columns, n_rows, row_no, cells)``: schema, row count and the first rows of a table.

    The count reads no column. Without ``order`` the rows are the first found.
    """
    rows = min(limits.sheet_rows, limits.parquet_rows) if n is None else n
    df = spark.read.parquet(path)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    head = table_preview(df, "", rows, order)
    return head.select(
        F.lit(columns).alias("columns"), total.scalar().alias("n_rows"), "row_no", "cells"
    )


def image_catalog(spark: SparkSession, path: str | Sequence[str], pixels: bool = False) -> DataFrame:
    """``(path, width, height, n_channels, mode[, data])`` of images; invalid ones are dropped."""
    images = (
        spark.read.format("image")
        .option("dropInvalid", True)
        .option("recursiveFileLookup", True)
        .load(path if isinstance(path, str) else list(path))
    )
    columns = [
        F.col("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.mode").alias("mode"),
    ]
    if pixels:
        columns.append(F.col("image.data").alias("data"))
    return images.select(*columns)


def image_headers(files: DataFrame) -> DataFrame:
    """``(path, format, width, height)`` of the images among files with ``path`` and ``content``, from
    their leading bytes; no pixel is decoded, and other files are left out."""
    found = files.select("path", image_header(F.col("content")).alias("h"))
    return found.filter("h IS NOT NULL").select("path", "h.*")


def write_previews(
    previews: DataFrame, path: str, mode: str = "error", compact: bool = False
) -> None:
    """Write preview rows as parquet, one directory per kind.

    Rows are not moved: every task writes one file per kind it holds. With ``compact`` the rows of
    a kind are brought together for fewer files; a hot kind is split over many tasks.
    """
    _by_kind(previews, compact).write.mode(mode).partitionBy("kind").parquet(path)


def write_preview_text(
    previews: DataFrame, path: str, mode: str = "error", compact: bool = False
) -> None:
    """Write only the preview text, one directory per kind."""
    lines = previews.select("kind", F.col("text").alias("value"))
    _by_kind(lines, compact).write.mode(mode).partitionBy("kind").text(path)


def _by_kind(rows: DataFrame, compact: bool) -> DataFrame:
    return rows.hint("rebalance", "kind") if compact else rows


def content_text(content: Column) -> Column:
    """Binary content as text; null when it is not valid UTF-8."""
    return F.try_validate_utf8(content.cast("string"))
