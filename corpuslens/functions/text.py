"""Text extraction as column expressions; every function stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.widths import classes

# Unicode white space as one property test, which is much faster than a list of characters.
BLANKS = r"(?U)[^\S\n]++"  # all but the line feed
AT_ENDS = r"(?U)\A\s++|\s++\z"
AT_END = r"(?U)\s++\z"

# Markup that becomes a line break, replaced in this order.
BREAKS: tuple[tuple[str, str], ...] = (
    ("<mbp:pagebreak/>", "\n\n"),
    ("<mbp:pagebreak />", "\n\n"),
    ("<mbp:pagebreak>", "\n\n"),
    ("</p>", "</p>\n"),
    ("</div>", "</div>\n"),
    ("</h1>", "</h1>\n"),
    ("</h2>", "</h2>\n"),
    ("</h3>", "</h3>\n"),
    ("<br>", "\n"),
    ("<br/>", "\n"),
    ("<br />", "\n"),
    ("><p", ">\n<p"),
    ("><P", ">\n<P"),
)

ELLIPSIS = "\n…"
SLIDE_BREAK = "\n\n---\n\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that lambdas in ``body`` do not compute it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_unicode(text: Column) -> Column:
    """Trim Unicode white space, line feeds included, from both ends."""
    return F.regexp_replace(text, AT_ENDS, "")


def strip_tags(html: Column) -> Column:
    """Drop everything from ``<`` to the next ``>``; an unclosed ``<`` drops the rest."""
    return F.replace(F.regexp_replace(html, r"<[^>]*+(?:>|\z)", ""), F.lit(">"), F.lit(""))


def html_to_text(html: Column) -> Column:
    """Readable text: block ends become line feeds, tags go, other white space collapses."""
    out = html
    for markup, text in BREAKS:
        out = F.replace(out, F.lit(markup), F.lit(text))
    out = strip_tags(out)
    out = F.regexp_replace(out, BLANKS, " ")
    out = F.regexp_replace(out, r"(\A|\n) ", "$1")
    return F.regexp_replace(out, AT_END, "")


def truncate_chars(text: Column, limit: int = 5000) -> Column:
    """First ``limit`` characters and an ellipsis line when there are more; 0 means no limit."""
    if limit == 0:
        return text
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit(ELLIPSIS))
    )


def first_of(values: Column, limit: int) -> Column:
    """First ``limit`` elements of an array; 0 means all."""
    return F.slice(values, 1, limit) if limit else values


def xml_nodes(xml: Column, limit: int = 0) -> Column:
    """Trimmed, non-empty text nodes in document order, at most ``limit`` (0: all).

    Comments, CDATA, processing instructions and doctype are not text, but they do end a node.
    """
    bare = F.regexp_replace(xml, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", "<>")
    nodes = F.transform(F.split(bare, r"<[^>]*+(?:>|\z)", -1), trim_unicode)
    return first_of(F.filter(nodes, lambda node: node != ""), limit)


def xml_text_nodes(xml: Column, limit: int = 0) -> Column:
    """Text nodes, each on its own line."""
    return F.array_join(F.transform(xml_nodes(xml, limit), lambda n: F.concat(n, F.lit("\n"))), "")


def docx_paragraph_array(xml: Column) -> Column:
    """Text nodes per ``<w:p>``, each followed by a space; empty paragraphs dropped."""
    chunks = F.split(xml, r"<w:p(?:\s(?:[^>]*[^/>])?)?>", -1)
    paragraphs = F.transform(
        chunks,
        lambda chunk: F.array_join(
            F.transform(xml_nodes(chunk), lambda n: F.concat(n, F.lit(" "))), ""
        ),
    )
    return F.filter(paragraphs, lambda p: p != "")


def docx_paragraphs(xml: Column, limit: int = 0) -> Column:
    """Paragraphs of a text document, an empty line between them."""
    return F.array_join(first_of(docx_paragraph_array(xml), limit), "\n\n")


def odt_node_array(xml: Column) -> Column:
    """Every non-empty text node, untrimmed."""
    bare = F.regexp_replace(xml, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", "<>")
    return F.filter(F.split(bare, r"<[^>]*+(?:>|\z)", -1), lambda node: node != "")


def odt_text(xml: Column, limit: int = 0) -> Column:
    """Every non-empty text node untrimmed, each followed by a line feed."""
    nodes = first_of(odt_node_array(xml), limit)
    return F.array_join(F.transform(nodes, lambda n: F.concat(n, F.lit("\n"))), "")


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?s)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def epub_text(members: Column) -> Column:
    """Text of an epub from its ``members`` (``array<struct<seq, member, text>>``): the chapters in
    the reading order of the package file, each followed by a blank line.

    Without a package file, or when its order names no member, the chapters come in entry order.
    """

    def is_package(m: Column) -> Column:
        return F.endswith(F.lower(m["member"]), F.lit(".opf"))

    def chapters(all_members: Column) -> Column:
        package = F.get(F.filter(all_members, is_package), F.lit(0))
        folder = F.regexp_replace(package["member"], r"[^/]*\z", "")
        tags = r"(?s)<(?:\w+:)?{0}\s[^>]*>"
        items = F.transform(
            F.regexp_extract_all(package["text"], F.lit(tags.format("item")), F.lit(0)),
            lambda tag: F.struct(
                _attribute(tag, "id").alias("id"), _attribute(tag, "href").alias("href")
            ),
        )
        spine = F.transform(
            F.regexp_extract_all(package["text"], F.lit(tags.format("itemref")), F.lit(0)),
            lambda tag: _attribute(tag, "idref"),
        )

        def in_order(known: Column) -> Column:
            def chapter(idref: Column) -> Column:
                href = F.get(F.filter(known, lambda i: i["id"] == idref), F.lit(0))["href"]
                name = F.concat(folder, F.coalesce(F.try_url_decode(href), href))
                return F.get(F.filter(all_members, lambda m: m["member"] == name), F.lit(0))["text"]

            return F.filter(F.transform(spine, chapter), lambda t: t.isNotNull())

        def or_entries(ordered: Column) -> Column:
            entries = F.transform(
                F.filter(all_members, lambda m: ~is_package(m)), lambda m: m["text"]
            )
            return F.when(F.size(ordered) > 0, ordered).otherwise(entries)

        return let(let(items, in_order), or_entries)

    texts = F.transform(
        let(members, chapters), lambda html: F.concat(html_to_text(html), F.lit("\n\n"))
    )
    return F.array_join(texts, "")


def page_array(text: Column, sep: str = "\f") -> Column:
    """Pages between separators, each trimmed."""
    return F.transform(F.split(text, sep, -1), trim_unicode)


def join_pages(text: Column, sep: str = "\f") -> Column:
    """Pages joined again, a ruler line with the page number before page 2 and later."""
    numbered = F.transform(
        page_array(text, sep),
        lambda page, i: F.concat(
            F.when(i > 0, F.concat(F.lit("\n--- page "), (i + 1).cast("string"), F.lit(" ---\n\n")))
            .otherwise(F.lit("")),
            page,
        ),
    )
    return F.concat(F.array_join(numbered, ""), F.lit("\n"))


def join_slide_array(slides: Column, titled: bool = False) -> Column:
    """Slides (array of text) in order, as plain text or with numbered ruler lines."""
    if not titled:
        return F.array_join(slides, SLIDE_BREAK)
    numbered = F.transform(
        slides,
        lambda slide, i: F.concat(
            F.when(i > 0, F.concat(F.lit("\n--- slide "), (i + 1).cast("string"), F.lit(" ---\n\n")))
            .otherwise(F.lit("")),
            slide,
        ),
    )
    return F.concat(F.array_join(numbered, ""), F.lit("\n"))


def printable_runs(content: Column) -> Column:
    """Runs of at least four printable bytes of a binary column, white space collapsed."""
    latin = F.decode(content, "iso-8859-1")
    runs = F.array_join(F.regexp_extract_all(latin, F.lit(r"[\x20-\x7e\n\t]{4,}"), F.lit(0)), " ")
    return F.trim(F.regexp_replace(runs, r"[ \n\t]+", " "))


def legacy_text(content: Column, max_chars: int = 0, min_bytes: int = 20) -> Column:
    """Recovered text of one stream with its closing line feed, at most ``max_chars`` of it (0: all);
    null when there is too little."""
    text = F.concat(printable_runs(content), F.lit("\n"))
    text = F.substring(text, 1, max_chars) if max_chars else text
    return F.when(F.length(text) > min_bytes, text)


def sanitize(text: Column) -> Column:
    """Drop carriage returns and all control characters but the tab."""
    return F.regexp_replace(text, r"[\x00-\x08\x0A-\x1F\x7F-\x9F]", "")


def line_array(text: Column) -> Column:
    """Lines without their line feeds; a final line feed opens no further line."""
    closed = F.endswith(text, F.lit("\n")) | (text == "")
    return let(
        F.split(text, "\n", -1),
        lambda lines: F.slice(lines, 1, F.size(lines) - F.when(closed, 1).otherwise(0)),
    )


BLOCK = 256  # elements of an array that one pass appends to
FILL = "\0"  # stands behind a wide character, so that a text has one character per column
GONE = "\x02"  # a line of which nothing shows


def _columns(text: Column) -> Column:
    """Text with one character per column: no control characters but tabs and line feeds, none
    without a width, and a ``FILL`` behind every wide one."""
    zero, two = classes()

    def shown(clean: Column) -> Column:
        out = F.regexp_replace(clean, rf"(?md)^[{zero}]++$", GONE)
        out = F.regexp_replace(F.regexp_replace(out, f"[{zero}]", ""), f"([{two}])", rf"$1{FILL}")
        return F.when(F.rlike(clean, F.lit(r"[\xAD\x{300}-\x{10FFFF}]")), out).otherwise(clean)

    return let(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", ""), shown)


def _piece_pattern(width: int) -> str:
    """Longest run of ``width`` columns that does not end inside a wide character."""
    return rf"(?s).{{1,{width}}}(?!{FILL})" if width > 1 else f"(?s).{FILL}?"


def _fill_by_part(line: Column) -> Column:
    """Tabs filled where rows are whole and stops too: by the length of the part before alone."""

    def filled(parts: Column) -> Column:
        stops = F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1),
            lambda part: F.rpad(part, ((F.floor(F.length(part) / 8) + 1) * 8).cast("int"), F.lit(" ")),
        )
        return F.concat(F.array_join(stops, ""), F.element_at(parts, -1))

    return let(F.split(line, "\t", -1), filled)


def _fill_in_order(line: Column, width: int) -> Column:
    """Tabs filled one after the other: a wide character that did not fit has moved all that follows."""
    none = F.array().cast("array<string>")

    def column_after(col: Column, part: Column) -> Column:
        rows = F.regexp_extract_all(
            F.concat(F.repeat(F.lit("-"), col), part), F.lit(_piece_pattern(width)), F.lit(0)
        )
        whole = F.pmod(col + F.length(part) - 1, F.lit(width)) + 1  # rows without wide characters
        return (
            F.when(part == "", col)
            .when(F.contains(part, F.lit(FILL)), F.length(F.element_at(rows, -1)))
            .otherwise(whole)
        )

    def step(state: Column, part: Column) -> Column:
        def with_end(end: Column) -> Column:
            fill = 8 - F.pmod(end, F.lit(8))
            return F.struct(
                (F.pmod(end + fill - 1, F.lit(width)) + 1).alias("col"),
                F.concat(state["out"], F.array(F.concat(part, F.repeat(F.lit(" "), fill)))).alias("out"),
            )

        return let(column_after(state["col"], part), with_end)

    def block(state: Column, parts: Column) -> Column:
        start = F.struct(state["col"].alias("col"), none.alias("out"))
        return let(
            F.aggregate(parts, start, step),
            lambda done: F.struct(
                done["col"].alias("col"),
                F.concat(state["out"], F.array(F.array_join(done["out"], ""))).alias("out"),
            ),
        )

    def filled(parts: Column) -> Column:
        before = F.slice(parts, F.lit(1), F.size(parts) - 1)
        starts = F.sequence(F.lit(0), F.floor(F.size(parts) / F.lit(BLOCK)).cast("int"))
        blocks = let(before, lambda p: F.transform(starts, lambda b: F.slice(p, b * BLOCK + 1, BLOCK)))
        done = F.aggregate(blocks, F.struct(F.lit(0).alias("col"), none.alias("out")), block)
        return F.concat(F.array_join(done["out"], ""), F.element_at(parts, -1))

    return let(F.split(line, "\t", -1), filled)


def _fill_tabs(line: Column, width: int) -> Column:
    """Tabs as spaces up to the next multiple of eight columns of the row they are in."""
    in_order = _fill_in_order(line, width)
    if width % 8 == 0:
        in_order = F.when(F.contains(line, F.lit(FILL)), in_order).otherwise(_fill_by_part(line))
    return F.when(F.contains(line, F.lit("\t")), in_order).otherwise(line)


def visual_line_count(text: Column, width: int = 80) -> Column:
    """Number of pieces :func:`visual_line_array` cuts a text into, without cutting it."""

    def pieces(line: Column) -> Column:
        by_length = F.greatest(F.lit(1), F.ceil(F.length(line) / F.lit(width)).cast("int"))
        by_piece = F.regexp_count(line, F.lit(_piece_pattern(width)))
        return (
            F.when(line == GONE, 0).when(F.contains(line, F.lit(FILL)), by_piece).otherwise(by_length)
        )

    lines = F.split(_columns(text), "\n", -1)
    counts = F.transform(F.transform(lines, lambda line: _fill_tabs(line, width)), pieces)
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(total)


def visual_line_array(text: Column, width: int = 80) -> Column:
    """Array of ``(line_no, piece_no, text)``: each line cut into pieces of ``width`` columns.

    A final line feed opens one more, empty line. Wide characters take two columns and are never
    cut; marks and other characters without a width go, and a line of nothing else has no piece.
    Tabs fill to the next multiple of eight columns.
    """
    if width < 1:
        raise ValueError("width must be positive")

    def pieces(line: Column, i: Column) -> Column:
        cut = F.regexp_extract_all(line, F.lit(_piece_pattern(width)), F.lit(0))
        cut = F.when(line == "", F.array(F.lit(""))).when(line == GONE, F.array().cast("array<string>")).otherwise(cut)
        return F.transform(
            cut,
            lambda piece, k: F.struct(
                (i + 1).cast("bigint").alias("line_no"),
                (k + 1).cast("bigint").alias("piece_no"),
                F.replace(piece, F.lit(FILL), F.lit("")).alias("text"),
            ),
        )

    empty = F.array().cast("array<struct<line_no:bigint,piece_no:bigint,text:string>>")
    filled = F.transform(F.split(_columns(text), "\n", -1), lambda line: _fill_tabs(line, width))
    return F.when(text == "", empty).otherwise(F.flatten(F.transform(filled, pieces)))


def hex_line_array(content: Column, cols: int = 16) -> Column:
    """Hex dump lines of a binary column, ``cols`` bytes per line."""
    digits = F.regexp_replace(F.lower(F.hex(content)), "(..)", "$1 ")
    rows = F.regexp_extract_all(digits, F.lit(rf".{{1,{3 * cols}}}"), F.lit(0))
    shown = F.regexp_replace(F.decode(content, "iso-8859-1"), r"[^\x20-\x7e]", ".")
    chars = F.regexp_extract_all(shown, F.lit(rf".{{1,{cols}}}"), F.lit(0))
    offsets = F.transform(
        rows,
        lambda row, i: F.concat(
            F.lower(F.lpad(F.hex(i * cols), 8, F.lit("0"))),
            F.lit("  "),
            F.rpad(row, 3 * cols - 1, F.lit(" ")),
        ),
    )
    return F.zip_with(
        offsets, chars, lambda left, right: F.concat(left, F.lit("  |"), right, F.lit("|"))
    )


def json_value(text: Column) -> Column:
    """The one JSON value a text holds, as a variant; null when it is not exactly one. Repeated keys
    are an error unless the plan is built under :func:`corpuslens.session.last_key_wins`.

    The parser stops at the end of the first value and ignores what follows. So the text is parsed
    inside brackets, alone and with a value behind it: only if it is one whole value do both
    arrays have the expected size.
    """

    def elements(tail: str) -> Column:
        boxed = F.concat(F.lit("["), text, F.lit(tail))
        return F.try_variant_get(F.try_parse_json(boxed), "$", "array<variant>")

    return let(
        elements("]"),
        lambda alone: F.when((F.size(alone) == 1) & (F.size(elements(",0]")) == 2), F.get(alone, F.lit(0))),
    )


def json_canonical(text: Column) -> Column:
    """Valid JSON re-serialised with sorted keys, null when it does not parse."""
    return F.to_json(json_value(text))


def ini_entries(text: Column) -> Column:
    """Sorted ``array<struct<section, key, value>>``; the last of equal keys wins."""
    sections = F.split(F.concat(F.lit("\n"), text), r"\r?\n[ \t]*(?=\[[^\]\n]*\])", -1)

    def entries(block: Column, s: Column) -> Column:
        section = F.trim(F.regexp_extract(block, r"\A\[([^\]\n]*)\]", 1))
        body = F.regexp_replace(block, r"\A\[[^\]\n]*\][^\n]*", "")
        lines = F.filter(
            F.transform(F.split(body, "\n", -1), trim_unicode),
            lambda line: (line != "") & ~F.rlike(line, F.lit(r"\A[;#]")),
        )
        return F.transform(
            lines,
            lambda line, i: F.struct(
                section.alias("section"),
                trim_unicode(F.regexp_extract(line, r"\A([^=:]*+)", 1)).alias("key"),
                s.alias("block"),
                i.alias("pos"),
                trim_unicode(F.regexp_extract(line, r"(?s)\A[^=:]*+[=:](.*)\z", 1)).alias("value"),
            ),
        )

    def drop_overwritten(ordered: Column) -> Column:
        def is_last(e: Column, i: Column) -> Column:
            after = F.get(ordered, i + 1)
            other = (after["section"] != e["section"]) | (after["key"] != e["key"])
            return F.coalesce(other, F.lit(True))

        return F.filter(ordered, is_last)

    last = let(F.array_sort(F.flatten(F.transform(sections, entries))), drop_overwritten)
    return F.transform(
        last,
        lambda e: F.struct(
            e["section"].alias("section"), e["key"].alias("key"), e["value"].alias("value")
        ),
    )


def ini_text(text: Column) -> Column:
    """Entries written back: sections by name, ``key = value`` lines, a blank line after each."""

    def render_all(entries: Column) -> Column:
        def render(e: Column, i: Column) -> Column:
            opens = (i == 0) | (F.get(entries, i - 1)["section"] != e["section"])
            closes = F.coalesce(F.get(entries, i + 1)["section"] != e["section"], F.lit(True))
            title = F.concat(F.lit("["), e["section"], F.lit("]\n"))
            return F.concat(
                F.when(opens & (e["section"] != ""), title).otherwise(F.lit("")),
                e["key"],
                F.lit(" = "),
                e["value"],
                F.when(closes, F.lit("\n\n")).otherwise(F.lit("\n")),
            )

        return F.array_join(F.transform(entries, render), "")

    return let(ini_entries(text), render_all)


def _field(mark: str, stops: str) -> str:
    """Pattern of one field: quotes count only at its start; an open quote runs to the end."""
    return rf'(?:"(?:[^"]|"")*+(?:"[^{mark}{stops}]*+|\z)|(?!")[^{mark}{stops}]*+)'


def delimiter_mark(sep: str) -> str:
    """A separator as it is written in a pattern."""
    return "\\t" if sep == "\t" else "\\" + sep


def delimited_records(text: Column, sep: str = ",") -> Column:
    """Records of a delimited text; line breaks inside quotes do not end one, blank lines go."""
    field = _field(delimiter_mark(sep), r"\r\n")
    record = rf"(?![\r\n]|\z)({field}(?:{delimiter_mark(sep)}{field})*+)(?:\r\n|\r|\n|\z)"
    return F.regexp_extract_all(text, F.lit(record), F.lit(1))


def delimited_cells(record: Column, sep: str) -> Column:
    """Cells of one record: as many as it has, quotes removed."""
    cells = F.regexp_extract_all(
        F.concat(F.lit(sep), record), F.lit(rf"{delimiter_mark(sep)}({_field(delimiter_mark(sep), '')})"), F.lit(1)
    )
    quoted = r'(?s)\A"((?:[^"]|"")*+)"?(.*)\z'
    return F.transform(
        cells,
        lambda cell: F.when(
            F.startswith(cell, F.lit('"')),
            F.concat(
                F.replace(F.regexp_extract(cell, quoted, 1), F.lit('""'), F.lit('"')),
                F.regexp_extract(cell, quoted, 2),
            ),
        ).otherwise(cell),
    )


def delimited_text(text: Column, sep: str, rows: int = 0) -> Column:
    """Header and first ``rows`` records (0: all) as tab-joined lines."""
    return F.array_join(
        F.transform(
            first_of(delimited_records(text, sep), rows + 1 if rows else 0),
            lambda record: F.concat(F.array_join(delimited_cells(record, sep), "\t"), F.lit("\n")),
        ),
        "",
    )


def notebook_cells(text: Column) -> Column:
    """``array<struct<cell_type, text>>`` of a notebook; null when it has no cells."""
    cells = F.try_variant_get(json_value(text), "$.cells", "array<variant>")

    def is_string(value: Column) -> Column:
        return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))

    def as_text(value: Column) -> Column:
        parts = F.try_variant_get(value, "$", "array<variant>")
        joined = F.array_join(
            F.transform(
                F.filter(parts, is_string), lambda p: F.try_variant_get(p, "$", "string")
            ),
            "",
        )
        return (
            F.when(value.isNull(), F.lit(""))
            .when(parts.isNotNull(), joined)
            .when(is_string(value), F.try_variant_get(value, "$", "string"))
            .otherwise(F.to_json(value))
        )

    def cell(value: Column, i: Column) -> Column:
        declared = F.try_variant_get(value, "$.cell_type", "variant")
        kind = F.when(is_string(declared), F.try_variant_get(declared, "$", "string")).otherwise(
            F.lit("cell")
        )
        source = as_text(F.try_variant_get(value, "$.source", "variant"))
        return F.struct(
            kind.alias("cell_type"),
            F.concat(
                F.lit("## Cell "), (i + 1).cast("string"), F.lit(" ("), kind, F.lit(")\n\n"), source
            ).alias("text"),
        )

    return F.when(F.size(cells) > 0, F.transform(cells, cell))


def mode_string(mode: Column) -> Column:
    """Unix mode bits as ten characters."""
    kind = mode.bitwiseAND(0o170000)
    head = F.when(kind == 0o040000, "d").when(kind == 0o120000, "l").otherwise("-")
    bits = [
        F.when(mode.bitwiseAND(bit) != 0, letter).otherwise("-")
        for bit, letter in zip((0o400, 0o200, 0o100, 0o40, 0o20, 0o10, 4, 2, 1), "rwxrwxrwx")
    ]
    return F.concat(head, *bits)


def first_success(raw: Column, *candidates: Column) -> Column:
    """``struct<text, error>``: first candidate that is not null, else the raw text and a note."""
    found = F.coalesce(*candidates)
    return F.struct(
        F.coalesce(found, raw).alias("text"),
        F.when(found.isNull(), "no candidate gave output").alias("error"),
    )
