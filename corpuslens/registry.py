"""Kind registry: which kind claims which extensions and MIME patterns.

Order is priority; the first kind that claims an extension or a MIME type wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    extensions: tuple[str, ...] = ()
    mime: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """User rule: a custom kind with its extensions and MIME patterns."""

    name: str
    extensions: tuple[str, ...] = ()
    mime: tuple[str, ...] = ()


def _kind(name: str, extensions: str = "", mime: str = "") -> Kind:
    return Kind(name, tuple(extensions.split()), tuple(mime.split()))


# Kinds in priority order with their extensions and MIME patterns.
KINDS: tuple[Kind, ...] = (
    _kind("markdown", "md markdown mdown mkd mkdn", "text/markdown"),
    _kind("image", "png jpg jpeg gif webp bmp tiff heic ico", "image/*"),
    _kind("data", "csv tsv json yaml yml toml ini parquet feather msgpack"),
    _kind("pdf", "pdf", "application/pdf"),
    _kind("archive", "zip tar tgz gz bz2 xz 7z"),
    _kind(
        "code",
        "py js ts tsx jsx sh zsh bash rb go rs c h cpp hpp java kt swift lua sql "
        "html css scss vue php pl r xml svg",
    ),
    _kind("spreadsheet", "xlsx xls xlsm xlsb ods"),
    _kind("document", "docx odt rtf"),
    _kind("presentation", "pptx odp"),
    _kind(
        "legacy_office",
        "doc ppt xls",
        "application/msword application/vnd.ms-powerpoint application/vnd.ms-excel",
    ),
    _kind("directory"),
    _kind(
        "ebook",
        "epub mobi azw azw1 azw2 azw3 prc pdb fb2 fbz lit djvu djv cbz cbr opf",
        "application/epub+zip application/x-mobipocket-ebook "
        "application/vnd.amazon.ebook application/x-fictionbook+xml "
        "application/x-fictionbook application/djvu image/vnd.djvu",
    ),
    _kind(
        "media",
        "mp3 wav flac ogg oga opus m4a aac aiff aif wma wv mp4 mkv avi mov webm m4v",
        "audio/* video/*",
    ),
    _kind("font", "ttf otf woff woff2", "font/*"),
    _kind("database", "sqlite db sqlite3", "application/x-sqlite3"),
    _kind("email", "eml", "message/rfc822"),
    _kind("notebook", "ipynb", "application/x-ipynb+json"),
    _kind("plist", "plist"),
    _kind("fallback"),
)

KIND_NAMES: tuple[str, ...] = tuple(k.name for k in KINDS)


def winning_extensions() -> dict[str, tuple[str, ...]]:
    """Extensions per kind after priority: an extension claimed twice stays with the first kind."""
    owner: dict[str, str] = {}
    for kind in KINDS:
        for ext in kind.extensions:
            owner.setdefault(ext, kind.name)
    return {k.name: tuple(e for e in k.extensions if owner[e] == k.name) for k in KINDS}


def registry_frame(spark: SparkSession) -> DataFrame:
    """The registry as rows ``(kind, priority, extensions, mime)``; one row per kind."""
    rows = F.array(
        *[
            F.struct(
                F.lit(k.name).alias("kind"),
                F.lit(i).alias("priority"),
                F.array(*[F.lit(e) for e in k.extensions]).cast("array<string>").alias("extensions"),
                F.array(*[F.lit(m) for m in k.mime]).cast("array<string>").alias("mime"),
            )
            for i, k in enumerate(KINDS, start=1)
        ]
    )
    return spark.range(1).select(F.inline(rows))
