"""Detection as column expressions: no join, no shuffle, usable on streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import let
from corpuslens.registry import KIND_NAMES, KINDS, Rule, winning_extensions

# Leading bytes (hex, at a byte offset) and the MIME type they stand for.
MAGIC: tuple[tuple[int, str, str], ...] = (
    (0, "89504E470D0A1A0A", "image/png"),
    (0, "FFD8FF", "image/jpeg"),
    (0, "474946", "image/gif"),
    (8, "57454250", "image/webp"),
    (0, "424D", "image/bmp"),
    (0, "49492A00", "image/tiff"),
    (0, "4D4D002A", "image/tiff"),
    (0, "00000100", "image/vnd.microsoft.icon"),
    (4, "6674797068656963", "image/heif"),
    (4, "667479706D696631", "image/heif"),
    (0, "41542654464F524D", "image/vnd.djvu"),
    (0, "25504446", "application/pdf"),
    (60, "424F4F4B4D4F4249", "application/x-mobipocket-ebook"),
    (30, "6D696D65747970656170706C69636174696F6E2F657075622B7A6970", "application/epub+zip"),
    (0, "504B0304", "application/zip"),
    (0, "504B0506", "application/zip"),
    (0, "1F8B08", "application/gzip"),
    (0, "425A68", "application/x-bzip2"),
    (0, "FD377A585A00", "application/x-xz"),
    (0, "377ABCAF271C", "application/x-7z-compressed"),
    (257, "7573746172", "application/x-tar"),
    (0, "53514C69746520666F726D6174203300", "application/vnd.sqlite3"),
    (0, "494433", "audio/mpeg"),
    (0, "FFFB", "audio/mpeg"),
    (8, "57415645", "audio/x-wav"),
    (0, "664C6143", "audio/x-flac"),
    (0, "4F676753", "audio/ogg"),
    (8, "41494646", "audio/x-aiff"),
    (4, "667479704D3441", "audio/m4a"),
    (4, "6674797071742020", "video/quicktime"),
    (4, "66747970", "video/mp4"),
    (0, "1A45DFA3", "video/x-matroska"),
    (8, "41564920", "video/x-msvideo"),
    (0, "774F4646", "application/font-woff"),
    (0, "774F4632", "application/font-woff"),
    (0, "0001000000", "application/font-sfnt"),
    (0, "4F54544F00", "application/font-sfnt"),
)

# Root class ids of compound files (as stored) and their MIME types.
OLE_MAGIC = "D0CF11E0A1B11AE1"
OLE_CLASSES: tuple[tuple[str, str], ...] = (
    ("0609020000000000C000000000000046", "application/msword"),
    ("1008020000000000C000000000000046", "application/vnd.ms-excel"),
    ("2008020000000000C000000000000046", "application/vnd.ms-excel"),
    ("108D81649B4FCF1186EA00AA00B929E8", "application/vnd.ms-powerpoint"),
)


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.regexp_extract(path, r"([^/]+)/*\z", 1)


def ext_of(path: Column) -> Column:
    """Lower-cased last extension, null when the name has none."""
    return F.lower(F.get(F.regexp_extract_all(path, F.lit(r"[^/]\.([^./]+)/*\z"), F.lit(1)), F.lit(0)))


def constant(value: object, type_: str) -> Column:
    """A nested constant as one expression; the planner folds it into a literal."""
    return F.from_json(F.lit(json.dumps(value)), type_)


def kind_of_ext(ext: Column) -> Column:
    """Kind that owns an extension, null when nobody claims it."""
    owners = {e: kind for kind, extensions in winning_extensions().items() for e in extensions}
    return F.try_element_at(constant(owners, "map<string,string>"), ext)


def _by_leading_bytes(content: Column, value_of: Callable[[str], str | None]) -> Column:
    """First entry of the magic table that the bytes match, turned into a value.

    The table is one literal array, so the generated code stays small; each MIME type becomes its
    value when the plan is made.
    """

    def entry(offset: int, digits: str, mime: str) -> dict:
        return {"at": 2 * offset + 1, "bytes": digits, "value": value_of(mime)}

    def table(*entries: dict) -> Column:
        return constant(entries, "array<struct<at:int,bytes:string,value:string>>")

    def first(digits: Column, entries: Column) -> Column:
        def matches(m: Column) -> Column:
            return F.substring(digits, m["at"], F.length(m["bytes"])) == m["bytes"]

        return F.get(F.filter(entries, matches), F.lit(0))

    reach = max(offset + len(digits) // 2 for offset, digits, _ in MAGIC)
    magic = let(
        F.hex(F.substring(content, 1, reach)),
        lambda digits: first(digits, table(*[entry(*m) for m in MAGIC])),
    )
    head = F.decode(F.substring(content, 1, 64), "iso-8859-1")
    markup = F.when(
        F.rlike(head, F.lit(r"(?i)\A\s*<(?:!DOCTYPE )?HTML")),
        F.get(table(entry(0, "", "text/html")), F.lit(0)),
    ).when(
        F.rlike(head, F.lit(r"(?i)\A\s*<\?XML")), F.get(table(entry(0, "", "text/xml")), F.lit(0))
    )
    # First directory sector (little endian at byte 48) leads to the root class id at byte 80.
    sector = F.conv(
        F.concat(*[F.hex(F.substring(content, p, 1)) for p in (52, 51, 50, 49)]), 16, 10
    ).try_cast("bigint")
    class_id = F.hex(F.substring(content, ((sector + 1) * 512 + 81).try_cast("int"), F.lit(16)))
    classes = [entry(0, digits, mime) for digits, mime in OLE_CLASSES]
    ole = first(class_id, table(*classes, entry(0, "", "application/x-ole-storage")))
    is_ole = F.startswith(content, F.lit(bytes.fromhex(OLE_MAGIC)))
    return F.coalesce(F.when(is_ole, ole), magic, markup)["value"]


def sniff_mime(content: Column) -> Column:
    """MIME type from leading bytes (binary column), null when unknown."""
    return _by_leading_bytes(content, lambda mime: mime)


def mime_matches(pattern: Column, mime: Column) -> Column:
    """Pattern ending in ``/`` or holding ``*`` is a prefix; anything else must be equal."""
    prefix = F.regexp_replace(pattern, r"\*+\z", "")
    return (
        F.when(F.endswith(pattern, F.lit("/")), F.startswith(mime, pattern))
        .when(F.contains(pattern, F.lit("*")), F.startswith(mime, prefix))
        .otherwise(mime == pattern)
    )


def _matches_any(patterns: Sequence[str], mime: Column) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | mime_matches(F.lit(pattern), mime)
    return hit


def _matches(pattern: str, mime: str) -> bool:
    """:func:`mime_matches` for values known when the plan is made."""
    if pattern.endswith("/"):
        return mime.startswith(pattern)
    if "*" in pattern:
        return mime.startswith(pattern.rstrip("*"))
    return mime == pattern


def kind_of_mime(mime: Column) -> Column:
    """First kind, in priority order, with a pattern that matches the MIME type."""
    expr = None
    for kind in KINDS:
        if kind.mime:
            hit = _matches_any(kind.mime, mime)
            expr = F.when(hit, kind.name) if expr is None else expr.when(hit, kind.name)
    return expr


def kind_of_content(content: Column) -> Column:
    """Kind that claims the MIME type of the leading bytes; null when nobody does."""

    def kind(mime: str) -> str | None:
        return next((k.name for k in KINDS if any(_matches(p, mime) for p in k.mime)), None)

    return _by_leading_bytes(content, kind)


def custom_rules(rules: Sequence[Rule]) -> list[Rule]:
    """Rules that may apply: sorted by name, names of built-in kinds dropped."""
    return sorted((r for r in rules if r.name not in KIND_NAMES), key=lambda r: r.name)


def kind_by_rules(ext: Column, content: Column, rules: Sequence[Rule]) -> Column:
    """Name of the first user rule (by name) that claims the extension or the leading bytes."""
    own = custom_rules(rules)
    by_ext = F.lit(None).cast("string")
    for rule in reversed([r for r in own if r.extensions]):
        hit = ext.isin(*[e.lower() for e in rule.extensions])
        by_ext = F.when(hit, rule.name).otherwise(by_ext)
    if not any(r.mime for r in own):
        return by_ext

    def rule_of(mime: str) -> str | None:
        return next((r.name for r in own if any(_matches(p, mime) for p in r.mime)), None)

    return F.least(by_ext, _by_leading_bytes(content, rule_of))


def detect_kind(
    path: Column,
    is_dir: Column,
    content: Column,
    rules: Sequence[Rule] = (),
    unknown: str | None = "fallback",
) -> Column:
    """Directory, then extension, then MIME, then user rules, then ``unknown``.

    ``coalesce`` stops at the first hit, so leading bytes are looked at only for rows that have
    no known extension.
    """
    ext = ext_of(path)
    return F.coalesce(
        F.when(is_dir, "directory"),
        kind_of_ext(ext),
        kind_of_content(content),
        kind_by_rules(ext, content, rules),
        F.lit(unknown).cast("string"),
    )


def first_bytes(content: Column, limit: int) -> Column:
    """First ``limit`` bytes of a binary column; 0 means all."""
    return F.substring(content, 1, limit) if limit else content


def is_plain_ascii(content: Column, max_bytes: int = 65536) -> Column:
    """True when the first ``max_bytes`` bytes (0: all) are printable ASCII or ASCII white space."""
    head = F.decode(first_bytes(content, max_bytes), "iso-8859-1")
    return F.rlike(head, F.lit(r"\A[\x21-\x7E \t\n\f\r]*+\z"))


def text_or_hex(content: Column, max_bytes: int = 65536) -> Column:
    """``'text'`` or ``'hex'`` for a binary column."""
    return F.when(is_plain_ascii(content, max_bytes), "text").when(content.isNotNull(), "hex")
