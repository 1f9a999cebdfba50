from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import detect as D
from corpuslens.operators import rules as RL
from corpuslens.sources import files as S
from corpuslens.plans.preview import with_kind
from corpuslens.registry import KINDS, Rule, registry_frame, winning_extensions


def test_extension_is_the_last_one_in_lower_case(apply):
    paths = ["a.tar.GZ", ".bashrc", "foo.", "/a.b/foo", "x/y.Txt", "..foo", "dir.d/", ""]
    assert apply(D.ext_of, *paths) == ["gz", None, None, None, "txt", "foo", "d", None]


def test_first_kind_keeps_an_extension():
    owned = winning_extensions()
    assert "xls" in owned["spreadsheet"]
    assert "xls" not in owned["legacy_office"]
    assert len(KINDS) == 19


def test_registry_has_one_row_per_kind(spark):
    rows = registry_frame(spark).orderBy("priority").collect()
    assert [r["kind"] for r in rows][:3] == ["markdown", "image", "data"]
    assert len(rows) == 19


@pytest.mark.parametrize(
    ("head", "mime"),
    [
        (b"\x89PNG\r\n\x1a\n....", "image/png"),
        (b"\xff\xd8\xff\xe0", "image/jpeg"),
        (b"GIF89a", "image/gif"),
        (b"RIFF1234WEBPVP8 ", "image/webp"),
        (b"RIFF1234WAVEfmt ", "audio/x-wav"),
        (b"BM......", "image/bmp"),
        (b"%PDF-1.7", "application/pdf"),
        (b"PK\x03\x04" + b"x" * 26 + b"mimetypeapplication/epub+zip", "application/epub+zip"),
        (b"PK\x03\x04....", "application/zip"),
        (b"\x1f\x8b\x08", "application/gzip"),
        (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"),
        (b"SQLite format 3\x00", "application/vnd.sqlite3"),
        (b"ID3\x03", "audio/mpeg"),
        (b"OggS", "audio/ogg"),
        (b"\x00\x00\x00\x18ftypmp42", "video/mp4"),
        (b"\x00\x00\x00\x18ftypheic", "image/heif"),
        (b"  <!doctype HTML><p>", "text/html"),
        (b"<?xml version='1.0'?>", "text/xml"),
        (b"hello", None),
        (b"", None),
        (None, None),
    ],
)
def test_sniff(apply, head, mime):
    assert apply(D.sniff_mime, head, type_="binary") == [mime]


def test_compound_files_by_root_class(apply):
    blobs = []
    for digits, _ in D.OLE_CLASSES:
        blob = bytearray(4096)
        blob[:8] = bytes.fromhex(D.OLE_MAGIC)
        blob[48:52] = (2).to_bytes(4, "little")
        blob[3 * 512 + 80 : 3 * 512 + 96] = bytes.fromhex(digits)
        blobs.append(bytes(blob))
    blobs.append(bytes.fromhex(D.OLE_MAGIC) + bytes(2000))
    found = apply(D.sniff_mime, *blobs, type_="binary")
    assert found == [m for _, m in D.OLE_CLASSES] + ["application/x-ole-storage"]
    kinds = apply(D.kind_of_content, *blobs, type_="binary")
    assert kinds == ["legacy_office"] * 4 + [None]


def test_mime_patterns(spark):
    cases = [
        ("image/", "image/gif", True),
        ("image/*", "image/png", True),
        ("application/pdf", "application/pdf", True),
        ("application/pdf", "application/pdfx", False),
        ("a*b", "a*bc", True),
        ("a*b", "axb", False),
    ]
    df = spark.createDataFrame(cases, "p string, m string, want boolean")
    bad = df.filter(D.mime_matches(F.col("p"), F.col("m")) != F.col("want"))
    assert bad.count() == 0
    assert all(D._matches(p, m) == want for p, m, want in cases)


def test_static_and_column_resolution_agree(apply):
    mimes = sorted({m for _, _, m in D.MAGIC})
    by_column = apply(D.kind_of_mime, *mimes)
    expected = [next((k.name for k in KINDS if any(D._matches(p, m) for p in k.mime)), None) for m in mimes]
    assert by_column == expected


def test_cascade(spark):
    rules = [
        Rule("zz_custom", ("ipynb-custom",)),
        Rule("aa_custom", ("ipynb-custom",), ("application/zip",)),
        Rule("code", ("weird",)),
    ]
    rows = [
        ("d.md", True, None, "directory"),
        ("a.md", False, b"%PDF", "markdown"),
        ("a.xls", False, b"", "spreadsheet"),
        ("a.svg", False, b"<svg/>", "code"),
        ("scan", False, b"%PDF-1", "pdf"),
        ("pic", False, b"AT&TFORM....DJVU", "image"),
        ("x.ipynb-custom", False, b"{}", "aa_custom"),
        ("packed", False, b"PK\x03\x04", "aa_custom"),
        ("x.weird", False, b"", "fallback"),
        ("a.txt", False, b"hi", "fallback"),
    ]
    df = spark.createDataFrame(
        [r[:3] + (r[3],) for r in rows], "path string, is_dir boolean, content binary, want string"
    )
    got = with_kind(df, rules).collect()
    assert [(r["path"], r["kind"]) for r in got] == [(r["path"], r["want"]) for r in got]
    strict = with_kind(df, (), None).filter("path = 'a.txt'").collect()
    assert strict[0]["kind"] is None


def test_text_or_hex(apply):
    values = [b"plain\ttext\r\n\x0c", b"", b"\x0b", "é".encode(), b"\x00\x02RAWBYTES", None]
    assert apply(D.text_or_hex, *values, type_="binary") == ["text", "text", "hex", "hex", "hex", None]
    late = b"a" * 65536 + b"\xff"
    assert apply(D.text_or_hex, late, type_="binary") == ["text"]
    assert apply(lambda c: D.text_or_hex(c, 70000), late, type_="binary") == ["hex"]


def test_detection_needs_no_shuffle(spark):
    df = spark.createDataFrame([("a", False, b"")], "path string, is_dir boolean, content binary")
    plan = with_kind(df, [Rule("q", ("q",), ("image/*",))])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_rules_as_a_table(spark):
    rows = [("a.ZZZ", b"x"), ("b", b"GIF89a"), ("c.gif", b"GIF89a"), ("d", b"%PDF-1"), ("e", None), ("f.md", b"")]
    files = spark.createDataFrame(rows, "path string, content binary")
    rules = [Rule("b-image", (), ("image/*",)), Rule("a-zzz", ("zzz", "Gif"), ()), Rule("markdown", ("md",), ("*",)),
             Rule("c-pdf", (), ("application/pdf", "image/")), Rule("z-all", (), ("*",))]
    table = spark.createDataFrame([(r.name, list(r.extensions), list(r.mime)) for r in rules] + [(None, ["md"], None)],
                                  "name string, extensions array<string>, mime array<string>")
    got = {r["path"]: r["rule_kind"] for r in RL.with_rule_kind(files, table).collect()}
    kind = D.kind_by_rules(D.ext_of(F.col("path")), F.col("content"), rules)
    want = {r["path"]: r["k"] for r in files.select("path", kind.alias("k")).collect()}
    assert got == want == {"a.ZZZ": "a-zzz", "b": "b-image", "c.gif": "a-zzz", "d": "c-pdf", "e": None, "f.md": None}
    many = spark.range(5000).selectExpr("concat('n', id) AS name", "array(concat('e', id)) AS extensions", "array('q/*') AS mime")
    plan = RL.with_rule_kind(files, many)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_image_headers(spark):
    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data

    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xfe\xff\xff" + b"\xc0" * 65533 + b"\xff\xff\xff\xc4\x00\x02"
    jpeg += b"\xff\xc2\x00\x0b\x08\x01\x02\x03\x04\x01"
    blobs = {
        "png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (7).to_bytes(4, "big") + (70_000).to_bytes(4, "big")),
        "gif": b"GIF87a\x03\x01\x04\x00", "jpeg": jpeg, "ico": b"\0\0\1\0\1\0\0\x20",
        "bmp": b"BM" + bytes(12) + b"\x28\0\0\0" + (9).to_bytes(4, "little") + (-8).to_bytes(4, "little", signed=True),
        "core": b"BM" + bytes(12) + b"\x0c\0\0\0\x05\0\x06\0",
        "lossy": b"RIFF....WEBPVP8 " + bytes(10) + b"\x10\x40\x20\x80", "cut": b"\x89PNG\r\n\x1a\n",
        "lossless": b"RIFF....WEBPVP8L" + bytes(4) + b"/" + (99 | 49 << 14).to_bytes(4, "little"),
        "lost": b"\xff\xd8\xff\xda\0\4ab\xff\xc0", "none": b"text",
    }
    df = spark.createDataFrame(list(blobs.items()), "path string, content binary")
    got = {r["path"]: tuple(r)[1:] for r in S.image_headers(df).collect()}
    assert got == {
        "png": ("png", 7, 70_000), "gif": ("gif", 259, 4), "jpeg": ("jpeg", 0x304, 0x102), "ico": ("ico", 256, 32),
        "bmp": ("bmp", 9, 8), "core": ("bmp", 5, 6), "lossy": ("webp", 16, 32), "cut": ("png", None, None),
        "lossless": ("webp", 100, 50), "lost": ("jpeg", None, None),
    }
