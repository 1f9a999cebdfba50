from __future__ import annotations

import csv
import io
import json
import quopri
import random
import re
import time
import unicodedata
from email import message_from_string
from email.header import Header, decode_header, make_header
from email.mime.application import MIMEApplication
from email.mime.base import MIMEBase
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import mail as ML
from corpuslens.functions import text as T
from corpuslens.functions import widths
from corpuslens.operators import lines as L

SPACES = "\t\x0b\x0c\r \x85\xa0       　"


def random_texts(alphabet: list[str], n: int, seed: int, length: int = 25) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(length))) for _ in range(n)]


def model_strip(html: str) -> str:
    out, inside = [], False
    for c in html:
        if c == "<":
            inside = True
        elif c == ">":
            inside = False
        elif not inside:
            out.append(c)
    return "".join(out)


def model_html(html: str) -> str:
    for markup, text in T.BREAKS:
        html = html.replace(markup, text)
    out, inside = "", False
    for c in html:
        if c == "<":
            inside = True
        elif c == ">":
            inside = False
        elif inside:
            continue
        elif c == "\n":
            out += c
        elif c in SPACES:
            if out and out[-1] not in " \n":
                out += " "
        else:
            out += c
    return out.rstrip(SPACES + "\n")


MARKUP = ["<", ">", "<p>", "</p>", "<br/>", "<br>", "</h2>", "><p", "><P", "a", "b ", " ", "\n", "\t",
          "\xa0", "　", "\r", "\x0c", "</div>", "<mbp:pagebreak />"]


def test_strip_tags_like_a_state_machine(apply):
    texts = random_texts(MARKUP, 400, 1)
    assert apply(T.strip_tags, *texts) == [model_strip(t) for t in texts]


def test_html_to_text_like_a_state_machine(apply):
    texts = random_texts(MARKUP, 600, 2) + ["<div>rain <i>and</i> snow</div>"]
    assert apply(T.html_to_text, *texts) == [model_html(t) for t in texts]


def test_truncate_counts_characters(apply):
    cut = lambda c: T.truncate_chars(c, 3)
    assert apply(cut, "abc", "abcd", "ä😀öü", "") == ["abc", "abc\n…", "ä😀ö\n…", ""]
    assert apply(lambda c: T.truncate_chars(c, 0), "abcd") == ["abcd"]


def test_xml_text_nodes(apply):
    xml = (
        '<?xml version="1.0"?><!DOCTYPE x><FictionBook><!-- no > no --><body><p> one line </p>'
        "<![CDATA[skip]]><p>a &amp; b</p>\n<p></p>tail"
    )
    assert apply(T.xml_text_nodes, xml) == ["one line\na &amp; b\ntail\n"]
    assert apply(lambda c: T.xml_text_nodes(c, 1), xml) == ["one line\n"]
    assert apply(T.xml_text_nodes, "a<!--x-->b", "<only>", "") == ["a\nb\n", "", ""]


def test_docx_and_odt(apply):
    xml = (
        '<w:document><w:body><w:p/><w:p w:rsid="1"><w:r><w:t>One</w:t><w:t xml:space="preserve"> two </w:t>'
        "</w:r></w:p><w:p><w:pPr/></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>"
    )
    assert apply(T.docx_paragraphs, xml) == ["One two \n\nThree "]
    assert apply(lambda c: T.docx_paragraphs(c, 1), xml) == ["One two "]
    assert apply(T.odt_text, "<a> x </a><b>y</b>") == [" x \ny\n"]


def test_pages(spark, apply):
    assert apply(T.join_pages, "a \f b\fc") == [
        "a\n--- page 2 ---\n\nb\n--- page 3 ---\n\nc\n"
    ]
    df = spark.createDataFrame([(1, " a \f\f c")], "id int, text string")
    rows = L.split_pages(df).orderBy("page_no").collect()
    assert [(r["page_no"], r["text"]) for r in rows] == [(1, "a"), (2, ""), (3, "c")]


def model_runs(data: bytes) -> str:
    out, run = "", b""
    for b in data:
        if 0x20 <= b <= 0x7E or b in (9, 10):
            run += bytes([b])
        else:
            if len(run) >= 4:
                out += run.decode() + " "
            run = b""
    if len(run) >= 4:
        out += run.decode()
    return " ".join(out.split())


def test_printable_runs_like_a_scan(apply):
    rng = random.Random(3)
    pool = list(b"abc \n\t~") * 3 + [0, 11, 13, 127, 200, 255]
    blobs = [bytes(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400)]
    assert apply(T.printable_runs, *blobs, type_="binary") == [model_runs(b) for b in blobs]


def test_legacy_text_bounds(apply):
    long = b"x" * 9000
    got = apply(lambda c: T.legacy_text(c, 8000), b"a" * 19, b"a" * 20, long, type_="binary")
    assert got == [None, "a" * 20 + "\n", "x" * 8000]
    assert apply(T.legacy_text, long, type_="binary") == ["x" * 9000 + "\n"]


def test_sanitize(apply):
    assert apply(T.sanitize, "a\tb\r\x07\x1bc\x7f\x85d") == ["a\tbcd"]


def columns(c: str) -> int:
    if unicodedata.category(c) in ("Mn", "Me", "Cf"):
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def model_wrap(text: str, width: int) -> list[tuple[int, int, str]]:
    if not text:
        return []
    rows = []
    for no, line in enumerate(text.split("\n"), start=1):
        line = "".join(c for c in line if c == "\t" or not (ord(c) < 32 or 127 <= ord(c) < 160))
        if not line:
            rows.append((no, 1, ""))
            continue
        current, col, k = "", 0, 1
        for c in line:
            for piece in [" "] * (8 - col % 8) if c == "\t" else [c] * (columns(c) > 0):
                if col + columns(piece) > width and current:
                    rows.append((no, k, current))
                    current, col, k = "", 0, k + 1
                current += piece
                col += columns(piece)
        if current:
            rows.append((no, k, current))
    return rows


@pytest.mark.parametrize("width", [16, 1, 2, 7, 13, 80])
def test_wrap_like_a_cursor(apply, width):
    parts = ["a", "bc", " ", "\t", "\n", "\r", "äö", "\x07", "long-word-of-20-chars", "漢", "한글字", "Ａ", "🙂",
             "e\u0301", "\u200b", "\n\u0301\n", "\xad", "ｱ"]
    texts = random_texts(parts, 300, 4, 40)
    got = apply(lambda c: T.visual_line_array(c, width), *texts)
    want = [model_wrap(t, width) for t in texts]
    assert [[tuple(r) for r in rows] for rows in got] == want
    assert apply(lambda c: T.visual_line_count(c, width), *texts) == [len(w) for w in want]


def test_wide_characters_and_tabs_in_one_long_line(spark):
    text = "漢a\t" * 30_000 + "🙂"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = L.wrap_lines(df, 21).orderBy("row_no").collect()
    assert [r["text"] for r in rows] == [r[2] for r in model_wrap(text, 21)]


def test_width_classes_try_few_ranges_per_character(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([("".join(every),)], "text string")
    for inside, columns in zip(widths.classes(), (0, 2), strict=True):
        found = df.select(F.array_join(F.regexp_extract_all("text", F.lit(f"[{inside}]"), F.lit(0)), "")).first()[0]
        assert found == "".join(c for c in every if ord(c) >= 0xA0 and widths.width(c) == columns)
        depth, parts = 0, [0]
        for token in re.findall(r"&&\[|\[|\]+|\\x\{\w+\}-\\x\{\w+\}", inside):
            if token.startswith("]"):
                del parts[len(parts) - len(token) // 2 :]
            elif token == "&&[":
                parts.append(0)
            elif token != "[":
                parts[-1] += 1
            assert max(parts) <= 2 * widths.FAN


def test_wide_pages_of_a_long_text_are_counted_quickly(spark):
    line = "some letters,\tand 漢 between\n"
    df = spark.createDataFrame([(1, line * 150_000)], "id int, text string")
    L.page_counts(df.limit(0), 20, 30).collect()
    begun = time.monotonic()
    found = L.page_counts(df, 20, 30).first()["n_lines"]
    assert time.monotonic() - begun < 6
    assert found == (len(model_wrap(line, 30)) - 1) * 150_000 + 1


def test_lines_and_pages(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "1\n2\n3\n4\n5"), (3, "")], "id int, text string")
    numbered = L.number_lines(df).orderBy("id", "line_no").collect()
    assert [r["rendered"] for r in numbered[:2]] == ["   1| a", "   2| b"]
    assert len(numbered) == 7
    wrapped = L.wrap_lines(df).filter("id = 1").collect()
    assert len(wrapped) == 3
    pages = {r["id"]: (r["n_lines"], r["n_pages"]) for r in L.page_counts(df, 2).collect()}
    assert pages == {1: (3, 2), 2: (5, 3), 3: (0, 0)}
    placed = L.paginate(df, 2).filter("id = 2").orderBy("row_no").collect()
    assert [r["page_no"] for r in placed] == [1, 1, 2, 2, 3]


def test_wide_line_numbers_are_not_cut(spark):
    df = spark.createDataFrame([(1, "x\n" * 10001)], "id int, text string")
    last = L.number_lines(df).filter("line_no = 10001").collect()
    assert last[0]["rendered"] == "10001| x"


def model_hex(data: bytes, cols: int) -> list[str]:
    lines = []
    for at in range(0, len(data), cols):
        chunk = data[at : at + cols]
        pairs = " ".join(f"{b:02x}" for b in chunk) + "   " * (cols - len(chunk))
        shown = "".join(chr(b) if 0x20 <= b <= 0x7E else "." for b in chunk)
        lines.append(f"{at:08x}  {pairs}  |{shown}|")
    return lines


@pytest.mark.parametrize("cols", [1, 7, 16])
def test_hex_lines(apply, cols):
    rng = random.Random(cols)
    blobs = [rng.randbytes(rng.randrange(80)) for _ in range(100)]
    got = apply(lambda c: T.hex_line_array(c, cols), *blobs, type_="binary")
    assert got == [model_hex(b, cols) for b in blobs]


def test_hex_dump_stops_at_the_byte_limit(spark):
    df = spark.createDataFrame([(1, b"z" * 100)], "id int, content binary")
    assert L.hex_dump(df, 16, 40).count() == 3


def test_json_is_one_whole_value(apply):
    cases = {
        '{"b":1,"a":[1,2.5,null,"x"]}': '{"a":[1,2.5,null,"x"],"b":1}',
        " 7 ": "7",
        '"s"': '"s"',
        '{"k":1}}': None,
        "{}{}": None,
        "1 2": None,
        "1,2": None,
        "1] [2": None,
        "1,0] ": None,
        "": None,
        "{": None,
        "nope": None,
    }
    assert apply(T.json_canonical, *cases) == list(cases.values())


def test_notebook(spark):
    book = json.dumps(
        {
            "cells": [
                {"cell_type": "code", "source": ["a\n", "b", 3]},
                {"source": "one"},
                {"cell_type": 5, "source": {"z": 1, "a": None}},
                {"cell_type": "raw"},
            ]
        }
    )
    df = spark.createDataFrame(
        [(1, book), (2, '{"cells":[]}'), (3, "not json"), (4, '{"x":1}')], "id int, text string"
    )
    rows = L.notebook_cells(df).orderBy("id", "cell_no").collect()
    assert [r["text"] for r in rows[:4]] == [
        "## Cell 1 (code)\n\na\nb",
        "## Cell 2 (cell)\n\none",
        '## Cell 3 (cell)\n\n{"a":null,"z":1}',
        "## Cell 4 (raw)\n\n",
    ]
    assert [(r["cell_no"], r["text"], r["error"]) for r in rows[4:]] == [
        (None, '{"cells":[]}', None),
        (None, "not json", "invalid json"),
        (None, '{"x":1}', None),
    ]


def test_slides(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (1, 10, "c"), (2, 1, "only")]
    df = spark.createDataFrame(rows, "id int, no int, text string")
    plain = {r["id"]: r["text"] for r in L.join_slides(df, "no").collect()}
    assert plain == {1: "a\n\n---\n\nb\n\n---\n\nc", 2: "only"}
    titled = {r["id"]: r["text"] for r in L.join_slides(df, "no", titled=True).collect()}
    assert titled[1] == "a\n--- slide 2 ---\n\nb\n--- slide 3 ---\n\nc\n"


def test_slide_limit_is_exact(spark):
    df = spark.range(3000).selectExpr("1 AS id", "id AS no", "'' AS text")
    cut = L.join_slides(df, "no", max_chars=500).collect()[0]["text"]
    assert cut == ("\n\n---\n\n" * 2999)[:500] + "\n…"
    few = L.join_slides(df.filter("no < 72"), "no", max_chars=500).collect()[0]["text"]
    assert few == "\n\n---\n\n" * 71


def test_email(spark):
    raws = {
        1: "From: ann@mail.test\r\nTo: bo@mail.test\r\nSubject: Plan\r\n  folded\r\n\r\nSee you there\r\n",
        2: "From: a\nContent-Type: text/html\n\n<p>Hi <b>x</b></p>",
        3: "subject: q\nContent-Type: multipart/mixed; boundary=b\n\n--b",
        4: "From: a\nContent-Transfer-Encoding: base64\n\nAAAA",
        5: "Subject: =?utf-8?B?w6k=?=\n\nx",
        6: "no headers at all",
    }
    df = spark.createDataFrame(list(raws.items()), "id int, raw string")
    rows = {r["id"]: r for r in L.email_rows(df).collect()}
    assert (rows[1]["sender"], rows[1]["subject"]) == ("ann@mail.test", "Plan folded")
    assert rows[1]["body"] == "See you there\r\n" and rows[1]["error"] is None
    assert rows[2]["body"] == "Hi x" and rows[2]["recipient"] is None
    assert rows[3]["body"] == "" and rows[3]["error"] is None
    assert rows[3]["subject"] == "q"
    assert rows[4]["error"] is None and rows[4]["body"] == "\0\0\0"
    assert rows[5]["subject"] == "é" and rows[5]["error"] is None
    assert rows[6]["body"] == ""
    texts = df.select("id", ML.email_text(ML.email_fields(F.col("raw"))).alias("t")).collect()
    assert dict(map(tuple, texts))[2] == "From: a\n\nHi x"


def random_mail(rng: random.Random, depth: int = 0) -> MIMEBase:
    if depth < 4 and rng.random() < 0.5:
        part = MIMEMultipart(rng.choice(["mixed", "alternative", "related"]))
        for _ in range(rng.randrange(1, 4)):
            part.attach(random_mail(rng, depth + 1))
        return part
    if rng.random() < 0.2:
        return MIMEApplication(bytes(rng.randrange(256) for _ in range(90)))
    text = "".join(rng.choice(["word ", "é", "=", "漢字", "\n", "--x\n", "a" * 90, "<b>"]) for _ in range(rng.randrange(30)))
    part = MIMEText(text, rng.choice(["plain", "plain", "html"]), "utf-8")
    if rng.random() < 0.5:
        del part["Content-Transfer-Encoding"]
        part["Content-Transfer-Encoding"] = "quoted-printable"
        part.set_payload(quopri.encodestring(text.encode()).decode())
    if rng.random() < 0.2:
        part["Content-Disposition"] = "attachment; filename=x.txt"
    return part


def test_mail_like_the_standard_parser(spark):
    rng = random.Random(10)
    raws, want = [], []
    for i in range(120):
        mail = random_mail(rng)
        if not mail.is_multipart() and mail.get_content_maintype() == "text":
            del mail["Content-Disposition"]
        mail["Subject"] = Header(rng.choice(["plain", "ünï cödé", "漢字 " * 30]), "utf-8")
        raw = mail.as_string()
        raws.append((i, raw.replace("\n", "\r\n") if i % 2 else raw))
        read = message_from_string(raw)
        parts = [p for p in read.walk() if p.get_content_maintype() == "text" and "attachment" not in p.get("Content-Disposition", "")]
        best = next((p for p in parts if p.get_content_subtype() == "plain"), next(iter(parts), None))
        body = best and best.get_payload(decode=True).decode()
        if best and best.get_content_subtype() == "html":
            body = model_strip(body)
        want.append((str(make_header(decode_header(read["Subject"]))), body, None if best else "no text part"))
    df = spark.createDataFrame(raws, "id int, raw string")
    got = [(r["subject"], r["body"], r["error"]) for r in L.email_rows(df).orderBy("id").collect()]
    same = lambda t: t and t.replace("\r\n", "\n")
    assert [(s, same(b), e) for s, b, e in got] == [(s, same(b), e) for s, b, e in want]


def test_unreadable_mail_is_an_error(spark):
    raws = ["Content-Type: text/plain; charset=koi8-r\nContent-Transfer-Encoding: base64\n\nAAAA",
            "Content-Transfer-Encoding: base64\n\nA!", "Content-Type: multipart/mixed\n\nno boundary",
            "Subject: =?x-none?q?=E4?= b\n\n" + "--" + "\n--" * 50_000]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    rows = L.email_rows(df).orderBy("id").collect()
    assert [r["error"] for r in rows] == ["unreadable body", "unreadable body", "no text part", None]
    assert rows[3]["subject"] == "=?x-none?q?=E4?= b"


def test_ini(apply):
    raw = "; demo\n[app]\nname=x\nmode = a=b\n\n[terminal]\ntheme: dark\nflag\n# c\n[app]\nname = y\n"
    entries = apply(T.ini_entries, raw)[0]
    assert [tuple(e) for e in entries] == [
        ("app", "mode", "a=b"),
        ("app", "name", "y"),
        ("terminal", "flag", ""),
        ("terminal", "theme", "dark"),
    ]
    assert apply(T.ini_text, raw) == [
        "[app]\nmode = a=b\nname = y\n\n[terminal]\nflag = \ntheme = dark\n\n"
    ]
    assert apply(T.ini_text, "") == [""]


def test_delimited_text(apply):
    raw = 'a,b\n"x,""1\n2",3,4\r\n\n5\n,\n'
    assert apply(lambda c: T.delimited_text(c, ","), raw) == ['a\tb\nx,"1\n2\t3\t4\n5\n\t\n']
    assert apply(lambda c: T.delimited_text(c, ",", 1), raw) == ['a\tb\nx,"1\n2\t3\t4\n']
    assert apply(lambda c: T.delimited_text(c, "\t"), "k\tv\n1\t\n") == ["k\tv\n1\t\n"]


def test_delimited_like_the_csv_module(apply):
    alphabet = ["a", "b c", ",", ",", '"', '""', '"x"', "\n", "\r\n", "\r", "é", "|"]
    texts = random_texts(alphabet, 800, 6, 14)
    got = apply(
        lambda c: F.transform(T.delimited_records(c), lambda r: T.delimited_cells(r, ",")), *texts
    )
    for text, rows in zip(texts, got):
        want = [row for row in csv.reader(io.StringIO(text, newline="")) if row]
        assert rows == want, repr(text)


def test_modes(apply):
    values = [0o040755, 0o100644, 0o120777, 0o000, 0o755]
    want = ["drwxr-xr-x", "-rw-r--r--", "lrwxrwxrwx", "----------", "-rwxr-xr-x"]
    assert apply(T.mode_string, *values, type_="int") == want


def test_first_success(spark):
    df = spark.createDataFrame([("r", None, "b"), ("r", "a", "b"), ("r", None, None)], "r string, a string, b string")
    picked = df.select(T.first_success(F.col("r"), F.col("a"), F.col("b")).alias("p")).select("p.*")
    assert [tuple(r) for r in picked.collect()] == [
        ("b", None), ("a", None), ("r", "no candidate gave output")
    ]


def test_long_inputs_do_not_overflow(apply):
    """Patterns must not recurse: very long tags, quotes, lines and runs."""
    n = 300_000
    assert apply(T.strip_tags, "<" + "a" * n + ">x") == ["x"]
    assert len(apply(T.html_to_text, "a " * n)[0]) == 2 * n - 1
    assert apply(lambda c: F.size(T.delimited_records(c)), '"' + 'q""' * n + '"\n1\n') == [2]
    assert apply(lambda c: F.size(T.xml_nodes(c, n)), "<a>x</a>" * 50_000) == [50_000]


def test_many_tabs_in_one_line(spark):
    df = spark.createDataFrame([(1, "a\t" * 100_000 + "b"), (2, "a\tb\n\n" + "x" * 17), (3, "")], "id int, text string")
    counts = {r["id"]: r["n_lines"] for r in L.page_counts(df).collect()}
    assert counts == {1: 10_001, 2: 3, 3: 0}
    lines = L.wrap_lines(df.filter("id = 2"), 8).orderBy("row_no").collect()
    assert [r["text"] for r in lines] == ["a       ", "b", "", "x" * 8, "x" * 8, "x"]


def test_last_of_repeated_keys(spark):
    texts = ['{"b":1,"a":{"x":1,"x":[2]},"b":{"c":3}}', '{"a":1', "[1]", '{"a":1}{"a":2}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    rows = L.json_rows(df)
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
    got = [tuple(r)[1:] for r in rows.orderBy("id").collect()]
    assert got == [
        ('{"a":{"x":[2]},"b":{"c":3}}', None), (texts[1], "invalid json"), ("[1]", None),
        (texts[3], "invalid json"), (None, "invalid json"),
    ]
