"""Markdown structure inside one text value.

A document is cut into blocks by one regular expression over its numbered lines, so structure
comes out of a narrow projection: no window and no shuffle, whatever the size of a document.
All loops in the pattern are possessive, which Java runs without recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import let

_N = r"\d+\x01"  # number and separator in front of every line
_EOL = r"(?:\n|\z)"
_FENCE = r" {0,3}(?:`{3,}[^`\n]*|~{3,}[^\n]*)" + _EOL
_RULE = r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})" + _EOL
_ITEM = r" *(?:[-*+]|\d{1,9}[.)])(?=[ \t]|\n|\z)"
# What ends a table or a paragraph: a blank line or the start of another block.
_STOP = rf"(?:[ \t]*{_EOL}|{_FENCE}|{_RULE}| {{0,3}}#{{1,6}}(?:[ \t]|\n|\z)| {{0,3}}>|{_ITEM})"

_FENCE_BLOCK = (
    rf"{_N} {{0,3}}(?:(`{{3,}})[^`\n]*|(~{{3,}})[^\n]*){_EOL}"
    rf"(?:(?!{_N} {{0,3}}(?:\1`*|\2~*)[ \t]*{_EOL}){_N}[^\n]*{_EOL})*+"
    rf"(?:{_N} {{0,3}}(?:\1`*|\2~*)[ \t]*{_EOL})?"
)
_TABLE_BLOCK = (
    rf"(?!{_N}{_STOP}){_N}[^\n]*\n"
    rf"{_N} {{0,3}}(?=[^\n]*\|)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*+\|?[ \t]*{_EOL}"
    rf"(?:(?!{_N}{_STOP}){_N}[^\n]*{_EOL})*+"
)
_TOP = r"(?: ?(?:\3|\d{1,9}\4)(?=[ \t]|\n|\z))"  # another item of the same outer list
_INNER = r"(?: {2,}|\t)[ \t]*[^ \t\n]"  # indented line of an item
_LIST_BLOCK = (
    rf"(?!{_N}{_RULE}){_N} {{0,3}}(?:([-*+])|\d{{1,9}}([.)]))(?=[ \t]|\n|\z)[^\n]*{_EOL}"
    rf"(?:(?!{_N}(?:{_RULE}|{_FENCE}))(?:"
    rf"{_N}(?:{_TOP}|{_INNER})[^\n]*{_EOL}"
    rf"|(?!{_N}{_STOP}){_N}[^\n]*{_EOL}"
    rf"|(?:{_N}[ \t]*\n)++(?=(?!{_N}(?:{_RULE}|{_FENCE})){_N}(?:{_TOP}|{_INNER}))"
    r"))*+"
)
_QUOTE = r" {0,3}>"
_QUOTE_BLOCK = rf"(?:{_N}{_QUOTE}[^\n]*{_EOL})++"
_INDENTED = r"(?: {4}| {0,3}\t)[ \t]*[^ \t\n]"
_CODE_BLOCK = rf"{_N}{_INDENTED}[^\n]*{_EOL}(?:(?:{_N}[ \t]*\n)*+{_N}{_INDENTED}[^\n]*{_EOL})*+"
_TABLE_START = (
    rf"{_N}[^\n]*\n{_N} {{0,3}}(?=[^\n]*\|)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*+\|?[ \t]*{_EOL}"
)
_UNDERLINE = rf"{_N} {{0,3}}(?:=+|-+)[ \t]*{_EOL}"
_PLAIN = rf"(?!{_N}{_STOP})(?!{_TABLE_START})"  # a line that belongs to a paragraph
_PARAGRAPH = (
    rf"{_PLAIN}{_N}[^\n]*{_EOL}(?:{_PLAIN}(?!{_UNDERLINE}){_N}[^\n]*{_EOL})*+(?:{_UNDERLINE})?+"
)
_LINE = rf"{_N}[^\n]*{_EOL}"
_BLOCKS = (
    rf"{_FENCE_BLOCK}|{_TABLE_BLOCK}|{_LIST_BLOCK}|{_QUOTE_BLOCK}|{_CODE_BLOCK}|{_PARAGRAPH}|{_LINE}"
)
QUOTE_LEVELS = 4  # quotes inside quotes that are opened


def _opened(found: Column) -> Column:
    """Blocks with the outermost quotes replaced by the blocks inside them."""

    def inside(block: Column) -> Column:
        bare = F.regexp_replace(block, rf"(?dm)^({_N}){_QUOTE}[ \t]?", "$1")
        return F.when(
            F.rlike(block, F.lit(rf"\A{_N}{_QUOTE}")), F.regexp_extract_all(bare, F.lit(_BLOCKS), F.lit(0))
        ).otherwise(F.array(block))

    return F.flatten(F.transform(found, inside))


def blocks(text: Column, quotes: bool = True) -> Column:
    """Blocks of a document in order, each a run of numbered lines. With ``quotes`` the blocks inside
    quotes come in their place, without the marks; else a quote is one block."""
    numbered = F.array_join(
        F.transform(
            F.split(text, r"\r?\n", -1),
            lambda line, i: F.concat((i + 1).cast("string"), F.lit("\x01"), line),
        ),
        "\n",
    )
    found = F.regexp_extract_all(numbered, F.lit(_BLOCKS), F.lit(0))
    if not quotes:
        return found

    def opened(all_blocks: Column) -> Column:
        for _ in range(QUOTE_LEVELS):
            all_blocks = let(all_blocks, _opened)
        return all_blocks

    has_quotes = F.rlike(text, F.lit(rf"(?m)^{_QUOTE}"))
    return let(found, lambda f: F.when(has_quotes, opened(f)).otherwise(f))


def block_type(block: Column) -> Column:
    """``fence``, ``list``, ``quote``, ``code`` (indented), ``table``, ``heading`` (underlined),
    ``paragraph`` (of several lines) or ``line``: a single line that opens nothing, or an ATX heading."""
    item = rf"\A(?!{_N}{_RULE}){_N} {{0,3}}(?:[-*+]|\d{{1,9}}[.)])(?=[ \t]|\n|\z)"
    several = F.rlike(block, F.lit(r"\n."))
    return (
        F.when(F.rlike(block, F.lit(rf"\A{_N}{_FENCE}")), "fence")
        .when(F.rlike(block, F.lit(item)), "list")
        .when(F.rlike(block, F.lit(rf"\A{_N}{_QUOTE}")), "quote")
        .when(F.rlike(block, F.lit(rf"\A(?!{_TABLE_START}){_N}{_INDENTED}")), "code")
        .when(several & F.rlike(block, F.lit(rf"\A{_TABLE_START}")), "table")
        .when(several & F.rlike(block, F.lit(rf"\n{_UNDERLINE}\z")), "heading")
        .when(several, "paragraph")
        .otherwise("line")
    )


def heading(block: Column) -> Column:
    """``struct<line_no, level, text>`` of a ``heading`` block or a ``line`` that is one; null else."""
    atx = rf"\A{_N} {{0,3}}(#{{1,6}})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\n?\z"
    under = rf"\n{_N} {{0,3}}([=-])[=-]*[ \t]*\n?\z"
    first = F.regexp_extract(block, r"\A(\d+)", 1).cast("bigint")
    lines = F.split(F.regexp_replace(block, under, ""), "\n", -1)
    joined = F.array_join(
        F.transform(lines, lambda line: F.trim(F.regexp_replace(line, rf"\A{_N}", ""))), " "
    )
    return F.when(
        block_type(block) == "heading",
        F.struct(
            first.alias("line_no"),
            F.when(F.regexp_extract(block, under, 1) == "=", 1).otherwise(2).alias("level"),
            joined.alias("text"),
        ),
    ).when(
        F.rlike(block, F.lit(atx)),
        F.struct(
            first.alias("line_no"),
            F.length(F.regexp_extract(block, atx, 1)).alias("level"),
            F.regexp_extract(block, atx, 2).alias("text"),
        ),
    )


def indented_code(block: Column) -> Column:
    """Lines of an indented block without their four columns."""
    plain = F.regexp_replace(F.regexp_replace(block, r"\n\z", ""), rf"(?dm)^{_N}", "")
    return F.regexp_replace(plain, r"(?dm)^(?: {4}| {0,3}\t| +$)", "")


def block_lines(block: Column) -> Column:
    """``array<struct<line_no, text>>`` of a block."""
    return F.transform(
        F.split(F.regexp_replace(block, r"\n\z", ""), "\n", -1),
        lambda line: F.struct(
            F.regexp_extract(line, r"\A(\d+)", 1).cast("bigint").alias("line_no"),
            F.regexp_replace(line, rf"\A{_N}", "").alias("text"),
        ),
    )


def fence_lang(block: Column) -> Column:
    """Info string of a fenced block."""
    return F.trim(F.regexp_extract(block, rf"\A{_N} {{0,3}}(?:`{{3,}}|~{{3,}})([^\n]*)", 1))


def fence_code(block: Column) -> Column:
    """Lines between the markers; the indentation of the opening marker is taken off."""
    closer = rf"{_N} {{0,3}}(?:\1`*|\2~*)[ \t]*\n?\z"
    body = F.regexp_replace(
        block,
        rf"(?s)\A{_N} {{0,3}}(?:(`{{3,}})[^`\n]*|(~{{3,}})[^\n]*)(?:\n|\z)(?:(.*?){closer}|(.*)\z)",
        "$3$4",
    )
    indent = F.length(F.regexp_extract(block, rf"\A{_N}( {{0,3}})", 1))
    plain = F.regexp_replace(F.regexp_replace(body, r"\n\z", ""), rf"(?dm)^{_N}", "")
    out = plain
    for n in (1, 2, 3):
        out = F.when(indent == n, F.regexp_replace(plain, rf"(?dm)^ {{1,{n}}}", "")).otherwise(out)
    return out


def table_cells(line: Column) -> Column:
    """Cells of a pipe row, trimmed; ``\\|`` is a literal pipe."""
    inner = F.regexp_replace(F.trim(F.translate(line, "\t", " ")), r"\A\||(?<!\\)\|\z", "")
    return F.transform(
        F.split(inner, r"(?<!\\)\|", -1), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|")))
    )


def pad_cells(cells: Column, width: Column | int) -> Column:
    """Array brought to exactly ``width`` cells: missing ones empty, surplus ones cut."""
    width = F.lit(width) if isinstance(width, int) else width
    missing = F.greatest(width - F.size(cells), F.lit(0))
    kept = F.transform(cells, lambda c: F.coalesce(c, F.lit("")))
    return F.slice(F.concat(kept, F.array_repeat(F.lit(""), missing)), F.lit(1), width)


def alignments(delimiter: Column) -> Column:
    """``left``, ``center`` or ``right`` per column; left when nothing is stated."""
    return F.transform(
        table_cells(delimiter),
        lambda c: F.when(F.rlike(c, F.lit(r"\A:.*:\z")), "center")
        .when(F.endswith(c, F.lit(":")), "right")
        .otherwise("left"),
    )


def list_items(block: Column) -> Column:
    """Outer items of a list block; each chunk starts with its item line."""
    return F.split(
        F.regexp_replace(block, r"\n\z", ""), rf"\n(?={_N} ?(?:[-*+]|\d{{1,9}}[.)])(?:[ \t]|\n|\z))", -1
    )


def outer_number(block: Column) -> Column:
    """Number of the first item of a list block; 1 for bullets."""
    digits = F.regexp_extract(block, rf"\A{_N} *(\d{{1,9}})[.)]", 1)
    return F.coalesce(F.nullif(digits, F.lit("")), F.lit("1")).cast("bigint")


_ITEM_PARTS = r"\A( *)(?:([-*+])|(\d{1,9})([.)]))(?: +|\z)"
_OPEN = "array<struct<col:int,sort:string,next:bigint>>"


def _parse_item(segment: Column) -> Column:
    """An item line and the lines that continue it, up to the next item line."""

    def parse(lines: Column) -> Column:
        def parts(first: Column) -> Column:
            marker = F.trim(F.regexp_extract(first, _ITEM_PARTS, 0))
            more = F.filter(
                F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda l: F.trim(l["text"])),
                lambda l: l != "",
            )
            own = F.trim(F.regexp_replace(first, _ITEM_PARTS, ""))
            return F.struct(
                F.get(lines, F.lit(0))["line_no"].alias("line_no"),
                F.length(F.regexp_extract(first, _ITEM_PARTS, 1)).alias("indent"),
                F.length(marker).alias("width"),
                F.regexp_extract(marker, r"\d*", 0).alias("digits"),
                F.regexp_replace(marker, r"\d", "").alias("sort"),
                F.array_join(F.concat(F.array(own), more), " ").alias("text"),
            )

        return let(F.replace(F.get(lines, F.lit(0))["text"], F.lit("\t"), F.lit("    ")), parts)

    return let(block_lines(segment), parse)


def item_tree(chunk: Column) -> Column:
    """Items of one outer item and all below it, in line order:
    ``array<struct<line_no, depth, ordered, number, text>>``.

    The walk keeps the open items: the column where their content starts, their marker and the
    next number. An item closes every open item whose content starts right of its indentation;
    with the same marker as the outermost one it closes, it is that item's next sibling. Depth and
    number are written to a text and joined to the items afterwards, so the walk carries no rows.
    """
    segments = F.split(
        F.regexp_replace(chunk, r"\n\z", ""),
        rf"\n(?={_N}[ \t]*(?:[-*+]|\d{{1,9}}[.)])(?:[ \t]|\n|\z))",
        -1,
    )

    def step(acc: Column, item: Column) -> Column:
        def entered(kept: Column) -> Column:
            sibling = F.get(acc["open"], F.size(kept))
            follows = F.coalesce(sibling["sort"] == item["sort"], F.lit(False))
            stated = F.when(item["digits"] != "", item["digits"]).otherwise("1").cast("bigint")
            return let(
                F.when(follows, sibling["next"]).otherwise(stated),
                lambda number: F.struct(
                    F.concat(
                        kept,
                        F.array(
                            F.struct(
                                (item["indent"] + item["width"] + 1).alias("col"),
                                item["sort"].alias("sort"),
                                (number + 1).alias("next"),
                            )
                        ),
                    ).alias("open"),
                    F.concat(
                        acc["walked"],
                        F.size(kept).cast("string"),
                        F.lit(":"),
                        number.cast("string"),
                        F.lit(" "),
                    ).alias("walked"),
                ),
            )

        return let(F.filter(acc["open"], lambda o: o["col"] <= item["indent"]), entered)

    def joined(items: Column) -> Column:
        start = F.struct(F.array().cast(_OPEN).alias("open"), F.lit("").alias("walked"))
        walked = F.aggregate(items, start, step, lambda acc: acc["walked"])
        return F.zip_with(
            items,
            F.split(F.trim(walked), " ", -1),
            lambda item, place: F.struct(
                item["line_no"].alias("line_no"),
                F.substring_index(place, ":", 1).cast("int").alias("depth"),
                (item["digits"] != "").alias("ordered"),
                F.substring_index(place, ":", -1).cast("bigint").alias("number"),
                item["text"].alias("text"),
            ),
        )

    return let(F.transform(segments, _parse_item), joined)


_CODE = r"(?<!`)(`+)(?!`)(?:[^`]|(?!(?<!`)\1(?!`))`)*+\1(?!`)"


def _outside_code(text: Column, pattern: str, replacement: str) -> Column:
    """Replace ``pattern`` but step over code spans; groups of ``pattern`` start at 3."""
    code = _CODE.replace(r"\1", r"\2")
    return F.regexp_replace(text, rf"({code})|{pattern}", f"$1{replacement}")


def _label(text: Column) -> Column:
    """A link label in the form in which labels are equal."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def link_definitions(text: Column) -> Column:
    """``array<struct<label, title>>`` of a document's link definitions outside fences; of equal labels
    the first counts."""
    line = r"(?m)^(?:\d+\x01)? {0,3}\[([^\[\]\n]+)\]:[ \t]*[^\s]+(?:[ \t]+(?:\"([^\"\n]*)\"|'([^'\n]*)'))?[ \t]*$"

    def parse(found: Column) -> Column:
        return F.struct(
            _label(F.regexp_extract(found, line, 1)).alias("label"),
            F.concat(F.regexp_extract(found, line, 2), F.regexp_extract(found, line, 3)).alias("title"),
        )

    def outside(all_blocks: Column) -> Column:
        plain = F.filter(all_blocks, lambda b: block_type(b).isin("line", "paragraph"))
        return F.transform(F.regexp_extract_all(F.array_join(plain, "\n"), F.lit(line), F.lit(0)), parse)

    kind = "array<struct<label:string,title:string>>"
    found = let(blocks(text), outside).cast(kind)
    return F.when(F.contains(text, F.lit("]:")), found).otherwise(F.array().cast(kind))


def resolved(text: Column, definitions: Column) -> Column:
    """Text with its reference links as their texts and reference images as ``[image: label]``; what
    has no definition stays."""
    span = r"(!?)(?<!\\)\[((?:[^\[\]`]|`+[^`]*+`+)*+)\](?:\[([^\[\]]*+)\])?(?![(\[:])"
    code = _CODE.replace(r"\1", r"\4")
    either = F.lit(f"{span}|{code}")

    # Parts, label and definition are bound: in the body of a lambda they would be computed again
    # for every definition and every use.
    def one(hit: Column) -> Column:
        def known(shown: Column, found: Column) -> Column:
            alt = F.trim(F.concat(found["title"], F.lit(" "), shown))
            image = F.concat(F.lit("[image: "), F.when(alt == "", "image").otherwise(alt), F.lit("]"))
            text = F.when(F.startswith(hit, F.lit("!")), image).otherwise(shown)
            return F.when(found.isNull(), hit).otherwise(text)

        def looked_up(shown: Column) -> Column:
            label = F.regexp_extract(hit, span, 3)
            return let(
                let(
                    _label(F.when(F.trim(label) == "", shown).otherwise(label)),
                    lambda wanted: F.get(F.filter(definitions, lambda d: d["label"] == wanted), F.lit(0)),
                ),
                lambda found: known(shown, found),
            )

        return F.when(F.startswith(hit, F.lit("`")), hit).otherwise(
            let(F.regexp_extract(hit, span, 2), looked_up)
        )

    hits = F.concat(F.transform(F.regexp_extract_all(text, either, F.lit(0)), one), F.array(F.lit("")))
    joined = F.zip_with(F.split(text, either, -1), hits, lambda plain, hit: F.concat(plain, hit))
    has = (F.size(definitions) > 0) & F.contains(text, F.lit("["))
    return F.when(has, F.array_join(joined, "")).otherwise(text)


def inline_text(text: Column, keep_ticks: bool = True, definitions: Column | None = None) -> Column:
    """Inline markup removed: emphasis, strong, strike; a link becomes its text, an image
    ``[image: label]`` with title and alt text as label; code spans keep their backticks. With
    ``definitions`` (see :func:`link_definitions`) links and images by reference too.

    Every step runs only on texts that hold its marks.
    """
    dest = r"\(\s*(?:<[^>]*>|[^()\s]*)"
    inner = r"((?:`+[^`]*+`+|(?!{0})[^`])++)"
    title = r'(?:\s+"[^"]*")?\s*\)'

    def images(t: Column) -> Column:
        for label, pattern in (
            ("[image: $2 $1]", rf'!\[([^\[\]]+)\]{dest}\s+"([^"]+)"\s*\)'),
            ("[image: $1]", rf'!\[\]{dest}\s+"([^"]+)"\s*\)'),
            ("[image: $1]", rf'!\[([^\[\]]+)\]{dest}(?:\s+"")?\s*\)'),
            ("[image: image]", rf'!\[\]{dest}(?:\s+"")?\s*\)'),
        ):
            t = _image(t, pattern, label)
        return t

    def pairs(t: Column) -> Column:
        for mark in (r"\*\*", "__", "~~"):
            t = _outside_code(t, rf"(?<!\\){mark}(?=\S){inner.format(mark)}(?<=\S){mark}", "$3")
        return t

    def emphasis(t: Column) -> Column:
        t = _outside_code(t, rf"(?<!\\)\*(?=\S){inner.format('[*]')}(?<=[^\s\\])\*", "$3")
        return _outside_code(
            t, rf"(?<![\w\\])_(?=\S){inner.format('_')}(?<=[^\s\\])_(?!\w)", "$3"
        )

    link = rf"(?<![\\!])\[((?:[^\[\]`]|\[[^\[\]`]*\]|`+[^`]*+`+)++)\]{dest}{title}"
    ticks = r"(?<!`)(`+)(?!`)\s?((?:[^`]|(?!\1(?!`))`)*?)\s?\1(?!`)"
    steps = [
        (r"!\[", images),
        (r"\]\(", lambda t: _outside_code(t, link, "$3")),
        ("<[hm]", lambda t: _outside_code(t, r"<((?:https?|mailto):[^>\s]+)>", "$3")),
        (r"\*\*|__|~~", pairs),
        ("[*_]", emphasis),
        (r"\\", lambda t: _outside_code(t, r"\\([!-/:-@\[-`{-~])", "$3")),
    ]
    if not keep_ticks:
        steps.append(("`", lambda t: F.regexp_replace(t, ticks, "$2")))

    def guarded(t: Column, mark: str, step: Callable[[Column], Column]) -> Column:
        return let(t, lambda v: F.when(F.rlike(v, F.lit(mark)), step(v)).otherwise(v))

    def run(t: Column) -> Column:
        for mark, step in steps:
            t = guarded(t, mark, step)
        return t

    whole = text if definitions is None else let(text, lambda t: resolved(t, definitions))
    return let(whole, lambda t: F.when(F.rlike(t, F.lit(r"[*_`~\[<\\]")), run(t)).otherwise(t))


def _image(text: Column, pattern: str, label: str) -> Column:
    """Replace images outside code; code spans are cut out first so that each piece is one kind."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{_CODE}|[^`]++|`++"), F.lit(0))
    return F.array_join(
        F.transform(
            pieces,
            lambda piece: F.when(F.startswith(piece, F.lit("`")), piece).otherwise(
                F.regexp_replace(piece, pattern, label)
            ),
        ),
        "",
    )
