"""Mail messages as column expressions: nested parts, transfer encodings, encoded words, charsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import let, strip_tags

#: What the bytes 80 to 9F mean in Windows-1252; five mean nothing and stay.
C1_WINDOWS = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
C1 = "".join(map(chr, range(0x80, 0xA0)))
UNICODE = ("utf-8", "utf8", "us-ascii", "ascii", "")
LATIN = ("iso-8859-1", "latin1", "latin-1")
WINDOWS = ("windows-1252", "cp1252")



def _header(head: Column, name: str) -> Column:
    pattern = rf"(?im)^{name}:[ \t]*([^\r\n]*)"
    return F.when(F.rlike(head, F.lit(pattern)), F.regexp_extract(head, pattern, 1))


def _unfolded(head: Column) -> Column:
    return F.regexp_replace(head, r"\r?\n[ \t]+", " ")


def _parameter(value: Column, name: str) -> Column:
    found = F.regexp_extract(value, rf'(?i);\s*{name}\s*=\s*("[^"]*"|[^\s;"]*)', 1)
    return F.replace(found, F.lit('"'), F.lit(""))


def _decoded(content: Column, charset: Column) -> Column:
    """Bytes as text; null for a charset that is not known."""
    latin = F.decode(content, "iso-8859-1")
    name = F.lower(charset)
    return (
        F.when(name.isin(*UNICODE), F.make_valid_utf8(content.cast("string")))
        .when(name.isin(*LATIN), latin)
        .when(name.isin(*WINDOWS), F.translate(latin, C1, C1_WINDOWS))
    )


def quoted_printable(text: Column, charset: Column) -> Column:
    """Text behind quoted-printable: soft line breaks go, runs of ``=XX`` are bytes of the charset."""
    run = F.lit("(?:=[0-9A-Fa-f]{2})++")

    def join(joined: Column) -> Column:
        runs = F.concat(
            F.transform(
                F.regexp_extract_all(joined, run, F.lit(0)),
                lambda r: _decoded(F.unhex(F.replace(r, F.lit("="), F.lit(""))), charset),
            ),
            F.array(F.lit("")),
        )
        both = F.zip_with(F.split(joined, run, -1), runs, lambda plain, r: F.concat(plain, r))
        return F.when(F.exists(both, lambda p: p.isNull()), None).otherwise(F.array_join(both, ""))

    return let(F.regexp_replace(text, r"=[ \t]*\r?\n", ""), join)


def base64_text(text: Column, charset: Column) -> Column:
    """Text behind base64; null when it is none."""
    return _decoded(F.try_to_binary(F.regexp_replace(text, r"\s+", ""), F.lit("base64")), charset)


def encoded_words(value: Column) -> Column:
    """A header with its encoded words read; white space between two of them goes. Words in an
    unknown charset or form stay as they are."""
    pattern = r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?="

    def read(word: Column) -> Column:
        charset = F.regexp_replace(F.regexp_extract(word, pattern, 1), r"\*.*", "")
        text = F.regexp_extract(word, pattern, 3)
        spaced = F.replace(text, F.lit("_"), F.lit(" "))
        is_base64 = F.lower(F.regexp_extract(word, pattern, 2)) == "b"
        return F.coalesce(
            F.when(is_base64, base64_text(text, charset)).otherwise(quoted_printable(spaced, charset)), word
        )

    def join(joined: Column) -> Column:
        words = F.concat(
            F.transform(F.regexp_extract_all(joined, F.lit(pattern), F.lit(0)), read), F.array(F.lit(""))
        )
        plain = F.split(joined, pattern, -1)
        return F.array_join(F.zip_with(plain, words, lambda p, w: F.concat(p, w)), "")

    between = F.regexp_replace(value, r"(\?=)\s+(?==\?)", "$1")
    return F.when(F.contains(value, F.lit("=?")), let(between, join)).otherwise(value)


def _split_head(text: Column) -> Column:
    """``struct<head, body>`` at the first empty line; folded header lines are joined."""
    return let(
        F.split(text, r"\r?\n\r?\n", 2),
        lambda x: F.struct(
            _unfolded(F.get(x, F.lit(0))).alias("head"), F.coalesce(F.get(x, F.lit(1)), F.lit("")).alias("body")
        ),
    )


def _text_part(raw: Column) -> Column:
    """``struct<head, body>`` of the part of a multipart message that shows as its text, or null.

    Boundaries of all levels are delimiters at once: what stands between two delimiter lines is a
    part of some level, or nothing where the first one closes its level. Parts thus nest as deep as
    they like, and a level that is never closed ends with the one around it.
    """
    named = r'(?im)^content-type:[ \t]*multipart/[^\n]*?;[ \t]*boundary[ \t]*=[ \t]*("[^"\r\n]++"|[^"\s;]++)'
    quoted = F.transform(
        F.regexp_extract_all(_unfolded(raw), F.lit(named), F.lit(1)),
        lambda b: F.concat(F.lit(r"\Q"), F.replace(F.replace(b, F.lit('"'), F.lit("")), F.lit("\\"), F.lit("")), F.lit(r"\E")),
    )
    line = F.concat(F.lit("(?md)^--(?:"), F.array_join(quoted, "|"), F.lit(r")(?:--)?[ \t]*\r?$"))

    def between(delimiter: Column) -> Column:
        lines = F.regexp_extract_all(raw, delimiter, F.lit(0))
        chunks = F.split(raw, delimiter, -1)
        parts = F.zip_with(
            lines,
            F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0))),
            lambda opening, chunk: F.when(
                ~F.rlike(opening, F.lit(r"--[ \t\r]*\z")), _split_head(F.regexp_replace(chunk, r"\r?\n\z", ""))
            ),
        )
        return let(F.filter(parts, lambda p: p.isNotNull()), first_text)

    def first_text(parts: Column) -> Column:
        def of_kind(kind: str) -> Column:
            return F.get(F.filter(parts, lambda p: _is_text(p["head"], kind)), F.lit(0))

        return F.coalesce(of_kind("plain"), of_kind("html"), of_kind(""))

    return F.when(F.size(quoted) > 0, let(line, between))


def _is_text(head: Column, kind: str) -> Column:
    """Whether a part shows as text of a kind (any for an empty name) and is no attachment."""
    ctype = F.lower(F.coalesce(_header(head, "Content-Type"), F.lit("text/plain")))
    attached = F.rlike(F.coalesce(_header(head, "Content-Disposition"), F.lit("")), F.lit(r"(?i)\A\s*attachment"))
    return F.startswith(F.trim(ctype), F.lit(f"text/{kind}")) & ~attached


def email_fields(raw: Column) -> Column:
    """``struct<sender, recipient, subject, body, error>`` of a message.

    The body is the first plain text part that is no attachment, else the first HTML part without
    its tags, else the first other text; parts may nest. Base64 and quoted-printable bodies and the
    subject's encoded words are read; sender and recipient are as written. A message without a text
    part, in an unknown charset or in broken base64 has a null body and an error.
    """

    def read(part: Column) -> Column:
        head, body = part["head"], part["body"]
        ctype = F.coalesce(_header(head, "Content-Type"), F.lit("text/plain"))
        charset = _parameter(ctype, "charset")
        encoding = F.lower(F.trim(F.coalesce(_header(head, "Content-Transfer-Encoding"), F.lit(""))))
        text = (
            F.when(encoding == "base64", base64_text(body, charset))
            .when(encoding == "quoted-printable", quoted_printable(body, charset))
            .otherwise(body)
        )
        is_html = F.startswith(F.lower(F.trim(ctype)), F.lit("text/html"))
        return let(text, lambda t: F.when(is_html, strip_tags(t)).otherwise(t))

    def fields(message: Column) -> Column:
        head = message["head"]
        ctype = F.lower(F.trim(F.coalesce(_header(head, "Content-Type"), F.lit("text/plain"))))
        part = F.when(F.startswith(ctype, F.lit("multipart/")), _text_part(raw)).when(
            F.startswith(ctype, F.lit("text/")) | ~F.contains(ctype, F.lit("/")), message
        )

        def row(p: Column, text: Column) -> Column:
            return F.struct(
                _header(head, "From").alias("sender"),
                _header(head, "To").alias("recipient"),
                encoded_words(_header(head, "Subject")).alias("subject"),
                text.alias("body"),
                F.when(p.isNull(), "no text part").when(text.isNull(), "unreadable body").alias("error"),
            )

        return let(part, lambda p: let(F.when(p.isNotNull(), read(p)), lambda text: row(p, text)))

    return let(_split_head(raw), fields)


def email_text(fields: Column) -> Column:
    """Message as text: the present header lines, a blank line, the body."""

    def line(label: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(label), value, F.lit("\n")), F.lit(""))

    return F.concat(
        line("From: ", fields["sender"]),
        line("To: ", fields["recipient"]),
        line("Subject: ", fields["subject"]),
        F.lit("\n"),
        F.coalesce(fields["body"], F.lit("")),
    )
