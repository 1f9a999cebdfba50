"""Preview of a whole corpus: detect the kind, extract text, cut it to a bounded row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpuslens.functions import detect as D
from corpuslens.functions import mail as ML
from corpuslens.functions import text as T
from corpuslens.limits import DEFAULTS, Limits
from corpuslens.functions import trees as FT
from corpuslens.operators import trees
from corpuslens.registry import KIND_NAMES, Rule
from corpuslens.session import last_key_wins
from corpuslens.sources.archives import MEMBERS, TREE_EXTENSIONS, container_parts, listing_entries
from corpuslens.sources.files import (
    content_text,
    local_path,
    oversize_files,
    plain_path,
    readable_files,
    scan_files,
)

Extractor = Callable[[Column, Column], Column]

_PIECE = "struct<shape:string,title:string,text:string,error:string,cut:boolean>"

# What an unsupported preview says.
LEGACY_HINT = (
    "Best-effort OLE text extraction failed. "
    "Open in LibreOffice/Microsoft Office or convert to OpenXML (docx/xlsx/pptx)."
)


@dataclass
class Extractors:
    """User extractors by kind name, and the rules that bring in custom kinds.

    An extractor takes ``(text, content)`` columns and gives a text column; it may be a native
    expression or a pandas UDF. Null means no output, and the next candidate is tried.
    """

    functions: dict[str, list[Extractor]] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)

    def register(
        self,
        kind: str,
        fn: Extractor,
        extensions: Sequence[str] = (),
        mime: Sequence[str] = (),
    ) -> None:
        """Add an extractor; a name that is no built-in kind becomes a custom kind."""
        self.functions.setdefault(kind, []).append(fn)
        if kind not in KIND_NAMES and (extensions or mime):
            self.rules.append(Rule(kind, tuple(extensions), tuple(mime)))


def register_extractor(
    extractors: Extractors,
    kind: str,
    fn: Extractor,
    extensions: Sequence[str] = (),
    mime: Sequence[str] = (),
) -> Extractors:
    """Functional form of :meth:`Extractors.register`."""
    extractors.register(kind, fn, extensions, mime)
    return extractors


def _piece(
    shape: Column | str,
    text: Column,
    title: Column | None = None,
    error: Column | None = None,
    cut: Column | None = None,
) -> Column:
    """A preview; ``cut`` says whether content was left out before the text was made."""
    return F.struct(
        (F.lit(shape) if isinstance(shape, str) else shape).alias("shape"),
        (F.lit(None).cast("string") if title is None else title).alias("title"),
        text.alias("text"),
        (F.lit(None).cast("string") if error is None else error).alias("error"),
        (F.lit(False) if cut is None else F.coalesce(cut, F.lit(False))).alias("cut"),
    ).cast(_PIECE)


def _more(size: Column, limit: int) -> Column:
    """Whether there is more than a limit lets through; 0 lets all through."""
    return size > limit if limit else F.lit(False)


def hex_text(content: Column, path: Column, size: Column, mime: Column, limits: Limits) -> Column:
    """Head lines and hex dump of the first bytes."""
    rows = T.hex_line_array(D.first_bytes(content, limits.fallback_bytes), limits.hex_cols)
    return F.concat(
        F.lit("file: "),
        path,
        F.lit("\nsize: "),
        size.cast("string"),
        F.lit(" bytes\nmime: "),
        F.coalesce(mime, F.lit("unknown")),
        F.lit("\n"),
        F.array_join(F.transform(rows, lambda r: F.concat(r, F.lit("\n"))), ""),
    )


def with_kind(
    df: DataFrame, rules: Sequence[Rule] = (), unknown: str | None = "fallback"
) -> DataFrame:
    """Add ``kind`` and ``ext`` to rows with ``path``, ``is_dir`` and binary ``content``."""
    path = F.col("path")
    return df.withColumn("ext", D.ext_of(path)).withColumn(
        "kind", D.detect_kind(path, F.col("is_dir"), F.col("content"), rules, unknown)
    )


def _by_kind(limits: Limits) -> Column:
    """The routing table: one ``CASE`` over the kind, each branch a preview piece."""
    path, content, text, ext = (F.col(c) for c in ("path", "content", "text", "ext"))
    members = F.col("members")
    member_text = F.get(members, F.lit(0))["text"]
    present = F.size(members) > 0
    entries, broken = F.col("entries"), F.col("broken")

    def only(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    def plain(
        value: Column, shape: str = "text", title: Column | None = None, cut: Column | None = None
    ) -> Column:
        return T.let(value, lambda v: F.when(v.isNotNull(), _piece(shape, v, title, None, cut)))

    def nodes(xml: Column) -> Column:
        """Text nodes of a document, and whether there were more."""
        return plain(
            T.xml_text_nodes(xml, limits.paragraphs),
            cut=_more(F.size(T.xml_nodes(xml)), limits.paragraphs) if limits.paragraphs else None,
        )

    def records(sep: str) -> Column:
        rows = limits.delimited_rows
        more = _more(F.size(T.delimited_records(text, sep)), rows + 1) if rows else None
        return plain(T.delimited_text(text, sep, rows), "table", cut=more)

    ascii_text = F.decode(D.first_bytes(content, limits.fallback_bytes), "iso-8859-1")
    is_text = D.is_plain_ascii(content, limits.fallback_bytes)
    past_head = _more(F.length(content), limits.fallback_bytes)
    raw = F.when(is_text, _piece("text", ascii_text, cut=past_head)).when(
        content.isNotNull(),
        _piece(
            "hex",
            hex_text(content, path, F.col("size"), D.sniff_mime(content), limits),
            cut=past_head,
        ),
    )

    def unsupported(reason: Column, hint: Column | str) -> Column:
        message = F.concat(reason, F.lit("\n"), F.lit(hint) if isinstance(hint, str) else hint)
        return _piece("unsupported", message, None, reason)

    size_note = F.concat(F.lit(" ("), F.col("size").cast("string"), F.lit(" bytes)"))
    no_codec = F.when(is_text, _piece("text", ascii_text, cut=past_head)).otherwise(
        unsupported(
            F.concat(F.col("kind"), F.lit(" file: "), path, size_note),
            "No text extractor for this kind; register one.",
        )
    )
    slides = T.let(
        T.notebook_cells(text),
        lambda cells: T.join_slide_array(F.transform(cells, lambda c: c["text"])),
    )
    mail = ML.email_fields(text)
    printable = T.legacy_text(content, 0, limits.legacy_min)

    data = (
        F.when(ext == "csv", records(","))
        .when(ext == "tsv", records("\t"))
        .when(
            (ext == "json") & text.isNotNull(),
            T.let(
                T.json_canonical(text),
                lambda j: _piece("text", F.coalesce(j, text), None, F.when(j.isNull(), "invalid json")),
            ),
        )
        .when(ext == "ini", plain(T.ini_text(text)))
    )
    document = F.when(ext == "rtf", plain(text)).when(
        present,
        F.when(
            ext == "docx",
            plain(
                T.docx_paragraphs(member_text, limits.paragraphs),
                cut=_more(F.size(T.docx_paragraph_array(member_text)), limits.paragraphs),
            ),
        ).otherwise(
            plain(
                T.odt_text(member_text, limits.paragraphs),
                cut=_more(F.size(T.odt_node_array(member_text)), limits.paragraphs),
            )
        ),
    )
    slide_texts = F.transform(members, lambda m: T.xml_text_nodes(m["text"]))
    is_zip = F.startswith(content, F.lit(b"PK"))
    ebook = (
        F.when((ext == "epub") & present, plain(T.epub_text(members)))
        .when(ext.isin("fb2", "fbz") & present, nodes(member_text))
        .when((ext == "fb2") & ~is_zip, nodes(text))
        .when(
            ext == "opf",
            plain(
                F.concat(F.lit("EPUB package (OPF)\n\n"), T.xml_text_nodes(text, limits.paragraphs)),
                cut=_more(F.size(T.xml_nodes(text)), limits.paragraphs),
            ),
        )
        .otherwise(no_codec)
    )
    bad_container = _piece("unsupported", broken, None, broken)

    tree, bare_tree = F.col("tree"), F.lit("")
    archive = F.when(
        tree.isNotNull(), _piece("tree", tree, F.concat(F.lit("Archive: "), path), cut=F.col("more"))
    ).when(broken.isNotNull(), bad_container)
    comic = F.when(entries.isNotNull(), comic_piece(entries, limits)).when(broken.isNotNull(), bad_container)
    directory = _piece(
        "tree", F.coalesce(tree, bare_tree), F.concat(F.lit("Directory: "), path), cut=F.col("more")
    )
    routed = (
        F.when(F.col("kind") == "archive", archive)
        .when((F.col("kind") == "ebook") & (ext == "cbz"), F.coalesce(comic, no_codec))
        .when(F.col("kind") == "markdown", plain(text, "markdown"))
        .when(F.col("kind") == "code", plain(text))
        .when(F.col("kind") == "data", data)
        .when(
            F.col("kind") == "pdf",
            only(~F.startswith(content, F.lit(b"%PDF")), plain(T.join_pages(text))),
        )
        .when(F.col("kind") == "document", document)
        .when(
            F.col("kind") == "presentation",
            only(present, plain(F.array_join(slide_texts, T.SLIDE_BREAK), "slides")),
        )
        .when(
            F.col("kind") == "notebook",
            F.coalesce(
                plain(slides, "slides"),
                F.when(
                    text.isNotNull(),
                    _piece("text", text, None, F.when(T.json_value(text).isNull(), "invalid json")),
                ),
            ),
        )
        .when(
            (F.col("kind") == "email") & text.isNotNull(),
            T.let(mail, lambda m: _piece("text", ML.email_text(m), None, m["error"])),
        )
        .when(F.col("kind") == "ebook", ebook)
        .when(
            F.col("kind") == "legacy_office",
            T.let(
                printable,
                lambda p: F.when(
                    p.isNotNull(),
                    _piece(
                        "text",
                        F.substring(p, 1, limits.legacy_chars) if limits.legacy_chars else p,
                        cut=_more(F.length(p), limits.legacy_chars),
                    ),
                ).otherwise(
                    unsupported(F.concat(F.lit("Legacy Office file: "), path, size_note), LEGACY_HINT)
                ),
            ),
        )
        .when(F.col("kind") == "directory", directory)
        .when(
            F.col("kind").isin("image", "media", "font", "spreadsheet", "database", "plist"),
            no_codec,
        )
    )
    return F.coalesce(
        routed, raw, _piece("unsupported", F.lit("unreadable"), None, F.lit("no content"))
    )


def with_trees(df: DataFrame, limits: Limits) -> DataFrame:
    """Add ``tree``, the drawn entries of archives and directories, and ``more``: whether some were left
    out. Rows of other kinds have neither."""
    most = limits.dir_entries
    listed = FT.with_listing(
        df,
        F.when(F.col("kind") == "directory", F.col("entries")),
        "listed",
        limits.dir_depth,
        most and most + 1,
    )
    packed = F.filter("entries", lambda e: ~FT.is_noise(e["path"]))
    of_archive = F.col("kind") == "archive"
    shown = listed.withColumn("shown", F.when(of_archive, packed).otherwise(F.col("listed")))
    limit = F.when(of_archive, limits.archive_entries or 2**31 - 1).otherwise(most or 2**31 - 1)
    shown = shown.withColumn("more", F.size("shown") > limit)
    drawn = FT.with_tree_text(shown, F.slice("shown", F.lit(1), limit), "tree")
    return drawn.drop("listed", "shown")


@last_key_wins
def preview_corpus(
    df: DataFrame,
    limits: Limits = DEFAULTS,
    extractors: Extractors | None = None,
    unknown: str | None = "fallback",
) -> DataFrame:
    """``(id, kind, shape, title, text, n_chars, truncated, error)``, one row per input row.

    ``truncated`` is true when any limit left something out; ``n_chars`` counts the text before the
    limits on characters.

    ``df`` has ``id``, ``path``, ``is_dir``, ``size`` and ``content`` (text or bytes), and may have
    ``entries`` (see :mod:`corpuslens.functions.trees`): the listing of a directory, drawn as a tree.
    Containers are opened once, in the row: documents for their text, archives and comics for
    their entries; nothing of them is shuffled. Everything is one narrow projection over a single
    scan, so it works on streams too. User extractors of a kind come first, then the built-in one,
    then text or hex.
    """
    if isinstance(df.schema["content"].dataType, ST.BinaryType):
        text, content = content_text(F.col("content")), F.col("content")
    else:
        text, content = F.col("content"), F.encode(F.col("content"), "utf-8")
    path = F.col("path")
    size = F.coalesce(F.col("size").cast("bigint"), F.length(content))
    listing = F.col("entries") if "entries" in df.columns else F.lit(None).cast(FT.ENTRIES)
    if "members" in df.columns:
        opened = F.struct(
            F.col("members").alias("members"), F.lit(None).alias("entries"), F.lit(None).alias("error")
        ).cast(f"struct<members:{MEMBERS},entries:array<struct<seq:bigint,path:string,is_dir:boolean,"
               "size:bigint,bits:bigint>>,error:string>")  # fmt: skip
    else:
        opened = container_parts(path, F.when(F.col("is_dir"), None).otherwise(content))
    rules = extractors.rules if extractors else ()
    base = df.select(
        "id",
        "path",
        "is_dir",
        size.alias("size"),
        content.alias("content"),
        text.alias("text"),
        listing.cast(FT.ENTRIES).alias("listing"),
        opened.alias("opened"),
    )
    base = base.select(
        "id",
        "path",
        "is_dir",
        "size",
        "content",
        "text",
        F.col("opened.members").alias("members"),
        F.when(F.col("is_dir"), F.col("listing"))
        .otherwise(listing_entries(path, F.col("size"), F.col("opened.entries")))
        .alias("entries"),
        F.col("opened.error").alias("broken"),
    )
    kinds = with_trees(with_kind(base, rules, unknown), limits)
    piece = _by_kind(limits)
    for kind, functions in (extractors.functions if extractors else {}).items():
        for fn in reversed(functions):
            own = fn(F.col("text"), F.col("content"))
            piece = F.coalesce(
                F.when((F.col("kind") == kind) & own.isNotNull(), _piece("text", own)), piece
            )
    pieces = kinds.select("id", "path", "kind", piece.alias("p"))
    full = F.col("p.text")
    too_long = _more(F.length(full), limits.text_chars)
    shown = T.truncate_chars(full, limits.text_chars)
    if limits.ebook_chars:
        ebook = F.col("kind") == "ebook"
        most = min(filter(None, (limits.ebook_chars, limits.text_chars)))
        too_long = F.when(ebook, F.length(full) > most).otherwise(too_long)
        shown = F.when(ebook, T.truncate_chars(full, most)).otherwise(shown)
    return pieces.select(
        "id",
        "kind",
        F.col("p.shape").alias("shape"),
        F.coalesce(F.col("p.title"), D.file_name(F.col("path"))).alias("title"),
        shown.alias("text"),
        F.length(full).cast("bigint").alias("n_chars"),
        (too_long | F.col("p.cut")).alias("truncated"),
        F.col("p.error").alias("error"),
    )


def comic_piece(entries: Column, limits: Limits) -> Column:
    """A comic archive as a list of its files. Every line has at least one character, so entries
    beyond the limit on characters cannot reach the text."""
    most = min(filter(None, (limits.text_chars, limits.ebook_chars)), default=2**31 - 1)
    shown = F.filter(entries, lambda e: ~FT.is_noise(e["path"], comic=True) & (e["seq"] <= most))
    note = lambda e: F.concat(F.lit(" ("), e["size"].cast("string"), F.lit(" bytes)"))
    lines = F.transform(
        shown, lambda e: F.concat(e["path"], F.when(e["is_dir"], "").otherwise(note(e)), F.lit("\n"))
    )
    total = F.size(entries).cast("string")
    return _piece(
        "text",
        F.concat(
            F.lit("Comic book archive — "),
            total,
            F.lit(" file(s)\n\n"),
            F.array_join(lines, ""),
            F.when(F.size(entries) > most, F.concat(F.lit("\n… "), total, F.lit(" entries total\n")))
            .otherwise(""),
        ),
    )


def _as_corpus(files: DataFrame) -> DataFrame:
    """Files of a listing in the form :func:`preview_corpus` takes."""
    return files.select(
        F.col("path").alias("id"),
        "path",
        F.lit(False).alias("is_dir"),
        F.col("length").alias("size"),
        "content",
    )


def preview_archives(files: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Archive files as drawn trees; unreadable ones as error rows."""
    packed = files.filter(D.ext_of(F.col("path")).isin(*TREE_EXTENSIONS))
    return preview_corpus(_as_corpus(packed), limits)


def preview_comics(files: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Comic zip archives (``cbz``) as a list of their files."""
    return preview_corpus(_as_corpus(files.filter(D.ext_of(F.col("path")) == "cbz")), limits)


def directory_entries(files: DataFrame, root: str) -> DataFrame:
    """Files below ``root`` as entries of one tree."""
    base = plain_path(root).rstrip("/") + "/"
    path = local_path(F.col("path"))
    return files.filter(F.startswith(path, F.lit(base))).select(
        F.lit(plain_path(root)).alias("tree_id"),
        F.lit(0).cast("bigint").alias("seq"),
        F.substr(path, F.lit(len(base) + 1)).alias("path"),
        F.lit(False).alias("is_dir"),
        F.col("length").alias("size"),
        F.lit(None).cast("string").alias("mode"),
    )


def preview_directory(files: DataFrame, root: str, limits: Limits = DEFAULTS) -> DataFrame:
    """One row with the drawn tree of a directory; only the file listing is used."""
    most = limits.dir_entries or 2**31 - 2
    listing = trees.list_limit(directory_entries(files, root), limits.dir_depth, most + 1)
    entry = F.struct("seq", "path", "is_dir", "size", "mode")
    whole = listing.groupBy("tree_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("seq") <= most, entry))).alias("entries"),
        (F.count(F.lit(1)) > most).alias("more"),
    )
    return FT.with_tree_text(whole, F.col("entries"), "full").select(
        F.col("tree_id").alias("id"),
        F.lit("directory").alias("kind"),
        F.lit("tree").alias("shape"),
        F.concat(F.lit("Directory: "), F.col("tree_id")).alias("title"),
        T.truncate_chars(F.col("full"), limits.text_chars).alias("text"),
        F.length("full").cast("bigint").alias("n_chars"),
        (_more(F.length("full"), limits.text_chars) | F.col("more")).alias("truncated"),
        F.lit(None).cast("string").alias("error"),
    )


def oversize_previews(files: DataFrame, extractors: Extractors | None = None) -> DataFrame:
    """Error rows of files too large for one value; they are not read."""
    none, rules = F.lit(None).cast("binary"), extractors.rules if extractors else ()
    return oversize_files(files).select(
        F.col("path").alias("id"),
        D.detect_kind(F.col("path"), F.lit(False), none, rules).alias("kind"),
        F.lit("unsupported").alias("shape"),
        D.file_name(F.col("path")).alias("title"),
        F.lit("file too large").alias("text"),
        F.lit(14).cast("bigint").alias("n_chars"),
        F.lit(True).alias("truncated"),
        F.lit("file too large").alias("error"),
    )


def preview_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    limits: Limits = DEFAULTS,
    extractors: Extractors | None = None,
) -> DataFrame:
    """Previews of files on storage, and one drawn tree per given directory."""
    roots = [paths] if isinstance(paths, str) else list(paths)
    files = scan_files(spark, roots)
    out = preview_corpus(_as_corpus(readable_files(files)), limits, extractors)
    out = out.unionByName(oversize_previews(files, extractors))
    for root in roots:
        out = out.unionByName(preview_directory(files, root, limits))
    return out
