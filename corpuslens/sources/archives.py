"""Zip and tar containers: the only place where bytes are opened in Python, on executors."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.detect import constant, ext_of, file_name
from corpuslens.functions.text import mode_string
from corpuslens.functions.trees import ENTRIES, is_noise
from corpuslens.limits import DEFAULTS
from corpuslens.operators.trees import cap_entries

# Text members per extension; the first column says whether only the first one counts.
MEMBER_PATTERNS: dict[str, tuple[bool, str]] = {
    "docx": (True, r"word/document\.xml"),
    "odt": (True, r"content\.xml"),
    "odp": (True, r"content\.xml"),
    "pptx": (False, r"ppt/slides/slide.*\.xml"),
    "fbz": (True, r"(?i).*\.fb2|fb2\.xml"),
    "fb2": (True, r"(?i).*\.fb2|fb2\.xml"),
    "epub": (False, r"(?i).*\.(?:opf|xhtml|html|htm)"),
}


# Extensions whose entries are listed.
TREE_EXTENSIONS: tuple[str, ...] = ("zip", "tar", "tgz", "gz", "bz2", "xz")


MEMBERS = "array<struct<seq:bigint,member:string,text:string,error:string>>"
_LISTED = "array<struct<seq:bigint,path:string,is_dir:boolean,size:bigint,bits:bigint>>"
MAX_MEMBER = 2**28  # bytes of an inflated member: what one value of a row may sensibly hold

GROUP_BYTES = 2**22  # about what a task's Python holds of found rows before they go on


def _entry_reader() -> Callable[[str, bytes], Iterator[tuple]]:
    """Function that yields ``(path, is_dir, size, mode bits)`` of a zip or tar file. Nested, so that
    it is shipped by value and executors need no copy of this package."""

    class StrictHeader(tarfile.TarInfo):
        """A damaged header is an error; by default it ends the archive in silence."""

        @classmethod
        def fromtarfile(cls, archive):
            try:
                return super().fromtarfile(archive)
            except (tarfile.InvalidHeaderError, tarfile.TruncatedHeaderError) as reason:
                raise tarfile.ReadError(str(reason)) from reason

    def entries(form: str, content: bytes) -> Iterator[tuple]:
        if form == "zip":
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                for info in archive.infolist():
                    yield info.filename, info.is_dir(), info.file_size, None
        else:
            data = io.BytesIO(bytes(content))
            with tarfile.open(fileobj=data, mode="r|*", tarinfo=StrictHeader) as archive:
                for info in archive:
                    path = info.name + "/" if info.isdir() else info.name
                    yield path, info.isdir(), info.size, info.mode

    return entries


def _archive_lister() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Function that lists archives batch by batch, shipped by value."""
    batch_rows = 10_000
    columns = ["archive", "form", "seq", "path", "is_dir", "size", "bits", "error"]
    types = {"seq": "Int64", "size": "Int64", "bits": "Int64", "is_dir": "boolean"}
    entries = _entry_reader()

    def list_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for archive, form, name, length, content in batch.itertuples(index=False):
                try:
                    opened = form in ("zip", "tar")
                    found = list(entries(form, content)) if opened else [(name, False, length, None)]
                    rows += [(archive, form, i, *e, None) for i, e in enumerate(found, start=1)]
                except Exception as reason:  # noqa: BLE001 - a bad archive must not fail the job
                    note = f"unreadable archive: {reason}"
                    rows.append((archive, form, None, None, None, None, None, note))
                if len(rows) >= batch_rows:
                    yield pd.DataFrame(rows, columns=columns).astype(types)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype(types)

    return list_batches


def _archive_form(path: Column, comic: bool = False) -> Column:
    """How an archive is listed, by its name; null for files that are none."""
    ext = ext_of(path)
    if comic:
        return F.when(ext == "cbz", "zip")
    tar = ext.isin("tgz", "tar") | F.endswith(F.lower(path), F.lit(".tar.gz"))
    return (
        F.when(ext == "zip", "zip")
        .when(tar, "tar")
        .when(ext == "gz", "gz")
        .when(ext.isin("bz2", "xz"), "single")
    )


def _entry_mode(form: Column, is_dir: Column, bits: Column) -> Column:
    constant_mode = F.when(is_dir, "drwxr-xr-x").otherwise("-rw-r--r--")
    return F.when(form == "tar", mode_string(bits)).when(form.isin("zip", "gz"), constant_mode)


def archive_manifest(
    files: DataFrame, max_entries: int | None = DEFAULTS.archive_entries, comic: bool = False
) -> DataFrame:
    """``(archive, seq, path, is_dir, size, mode, error)``, one row per entry.

    ``files`` has ``path``, ``length`` and ``content``. Zip entries have a constant mode; a lone
    gz, bz2 or xz file is one entry with its compressed size; an unreadable archive is one error
    row. Noise goes first, then every archive is cut to ``max_entries``. With ``comic`` only comic
    zip archives are listed, noise included.
    """
    named = files.select("path", "length", "content", _archive_form(F.col("path"), comic).alias("form"))
    archives = named.filter(F.col("form").isNotNull())
    # A lone compressed file is known by its name; only a gz shows just the last part of it.
    opened = archives.select(
        F.col("path").alias("archive"),
        "form",
        F.when(F.col("form") == "gz", file_name(F.col("path"))).otherwise(F.col("path")).alias("name"),
        F.col("length").cast("bigint").alias("length"),
        F.when(F.col("form").isin("zip", "tar"), F.col("content")).alias("content"),
    ).mapInPandas(
        _archive_lister(),
        "archive string, form string, seq bigint, path string, is_dir boolean, size bigint, "
        "bits bigint, error string",
    )
    mode = F.when(F.col("error").isNull(), _entry_mode(F.col("form"), F.col("is_dir"), F.col("bits")))
    entries = opened.select("archive", "seq", "path", "is_dir", "size", mode.alias("mode"), "error")
    if not comic:
        entries = entries.filter(F.col("error").isNotNull() | ~is_noise(F.col("path")))
    if max_entries is None:
        return entries
    capped = cap_entries(entries.withColumnRenamed("archive", "tree_id"), max_entries)
    return capped.withColumnRenamed("tree_id", "archive")


def manifest_entries(manifest: DataFrame) -> DataFrame:
    """Readable entries of a manifest in the form the tree operators take."""
    return manifest.filter(F.col("error").isNull()).select(
        F.col("archive").alias("tree_id"), "seq", "path", "is_dir", "size", "mode"
    )


def _container_reader() -> Callable[..., Column]:
    """Arrow UDF that opens each container once, for its text members or its entries; nested to be
    shipped by value. What is found goes on in groups of some megabytes, however many containers
    come at once."""
    most, entries, group = MAX_MEMBER, _entry_reader(), GROUP_BYTES
    member = [("seq", pa.int64()), ("member", pa.string()), ("text", pa.string()), ("error", pa.string())]
    listed = [("seq", pa.int64()), ("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64())]
    listed.append(("bits", pa.int64()))
    opened = pa.struct(
        [("members", pa.list_(pa.struct(member))), ("entries", pa.list_(pa.struct(listed))), ("error", pa.string())]
    )

    def weight(row: dict) -> int:
        """About the bytes that a found row takes."""
        texts = sum(500 + len(m["text"] or "") for m in row["members"] or ())
        return 100 + texts + 500 * len(row["entries"] or ())

    def member_text(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[str | None, str | None]:
        """Text of a member, or why there is none; the others of the container stay."""
        try:
            with archive.open(info) as stream:
                raw = stream.read(most + 1)
            if len(raw) > most:
                return None, f"member larger than {most} bytes"
            return raw.decode("utf-8"), None
        except Exception as reason:  # noqa: BLE001 - one bad member must not lose the container
            return None, f"unreadable member: {reason}"

    def read(blob: bytes, expr: str, once: bool) -> tuple[list[dict] | None, str | None]:
        members: list[dict] = []
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(blob))) as archive:
                for seq, info in enumerate(archive.infolist(), start=1):
                    if re.fullmatch(expr, info.filename):
                        text, error = member_text(archive, info)
                        members.append(
                            {"seq": seq, "member": info.filename, "text": text, "error": error}
                        )
                        if once:
                            break
        except Exception as reason:  # noqa: BLE001 - one bad container must not fail the job
            return None, f"unreadable container: {reason}"
        return (members, None) if members else (None, "no matching member")

    def list_entries(blob: bytes, form: str) -> tuple[list[dict] | None, str | None]:
        names = ("seq", "path", "is_dir", "size", "bits")
        try:
            return [dict(zip(names, (i, *e))) for i, e in enumerate(entries(form, blob), start=1)], None
        except Exception as reason:  # noqa: BLE001 - a bad archive must not fail the job
            return None, f"unreadable archive: {reason}"

    def open_one(blob: bytes | None, expr: str | None, once: bool | None, kind: str | None) -> dict:
        members = found = error = None
        if blob is not None and kind is not None:
            found, error = list_entries(blob, kind)
        elif blob is not None and expr is not None:
            members, error = read(blob, expr, bool(once))
        return {"members": members, "entries": found, "error": error}

    def open_all(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows, size = [], 0
            for row in zip(*columns):
                rows.append(open_one(*(x.as_py() for x in row)))
                size += weight(rows[-1])
                if size >= group:
                    yield pa.array(rows, opened)
                    rows, size = [], 0
            if rows:
                yield pa.array(rows, opened)

    # Marked as nondeterministic so that the planner never runs it twice for one row.
    return F.arrow_udf(
        open_all, f"members {MEMBERS}, entries {_LISTED}, error string"
    ).asNondeterministic()


def _opened(path: Column, content: Column, pattern: str | None, first_only: bool, form: Column) -> Column:
    if pattern is not None:
        chosen, once = F.lit(pattern), F.lit(first_only)
    else:
        ext = ext_of(path)
        patterns = {name: expr for name, (_, expr) in MEMBER_PATTERNS.items()}
        chosen = F.try_element_at(constant(patterns, "map<string,string>"), ext)
        single = [name for name, (first, _) in MEMBER_PATTERNS.items() if first]
        once = F.coalesce(ext.isin(*single), F.lit(False))
    is_zip = F.startswith(content, F.lit(b"PK"))
    if pattern is None:
        # An fb2 file may be plain text; other containers are always zip files.
        is_zip = is_zip | (ext != "fb2")
    blob = F.when((chosen.isNotNull() & is_zip) | form.isNotNull(), content)
    return _container_reader()(blob, chosen, once, form)


def container_members(
    path: Column, content: Column, pattern: str | None = None, first_only: bool = False
) -> Column:
    """``struct<members array<struct<seq, member, text, error>>, entries, error>`` of a zip-based
    document; its ``entries`` are null.

    Members are in entry order. Without ``pattern`` the extension decides which members are read.
    Only the bytes of containers go to Python; for other rows a null does, and the members of a
    file stay in its row, without a shuffle.
    """
    return _opened(path, content, pattern, first_only, F.lit(None).cast("string"))


def container_parts(path: Column, content: Column) -> Column:
    """``struct<members, entries, error>`` of a file that is a container, opened once: text members of
    a zip-based document, or the entries of an archive or comic, in the form
    :func:`listing_entries` completes. Archives of one file are listed without their bytes."""
    form = F.coalesce(_archive_form(path), _archive_form(path, comic=True))
    return _opened(path, content, None, False, F.when(form.isin("zip", "tar"), form))


def listing_entries(path: Column, size: Column, entries: Column) -> Column:
    """Entries of an archive with their modes; a lone compressed file is its own one entry. Null for
    files that are no archive or could not be read."""
    form = F.coalesce(_archive_form(path), _archive_form(path, comic=True))
    name = F.when(form == "gz", file_name(path)).otherwise(path)
    alone = F.struct(
        F.lit(1).cast("bigint").alias("seq"),
        name.alias("path"),
        F.lit(False).alias("is_dir"),
        size.cast("bigint").alias("size"),
        _entry_mode(form, F.lit(False), F.lit(0)).alias("mode"),
    )
    listed = F.transform(
        entries,
        lambda e: F.struct(
            e["seq"].alias("seq"),
            e["path"].alias("path"),
            e["is_dir"].alias("is_dir"),
            e["size"].alias("size"),
            _entry_mode(form, e["is_dir"], e["bits"]).alias("mode"),
        ),
    )
    return F.when(form.isin("gz", "single"), F.array(alone)).when(form.isNotNull(), listed).cast(ENTRIES)


def zip_member_text(
    files: DataFrame, pattern: str | None = None, first_only: bool = False
) -> DataFrame:
    """``(path, member, seq, text, error)`` of the matching members; a bad member has an error and no
    text, and an unreadable container, or one without such a member, is one error row."""
    found = files.select(
        "path",
        container_members(F.col("path"), F.col("content"), pattern, first_only).alias("found"),
    )
    rows = found.select(
        "path", F.col("found.error").alias("whole"), F.inline_outer("found.members")
    ).select("path", "member", "seq", "text", F.coalesce("whole", "error").alias("error"))
    return rows.filter(F.col("member").isNotNull() | F.col("error").isNotNull())
