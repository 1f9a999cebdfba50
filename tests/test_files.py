from __future__ import annotations
import gzip
import io
import json
import random
import struct
import tarfile
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.limits import UNCUT, Limits
from corpuslens.operators import trees as TR
from corpuslens.plans import preview as P
from corpuslens.plans import views as V
from corpuslens.sources import archives as A
from corpuslens.sources import files as S
from corpuslens.streaming import previews as ST


def png(width: int, height: int) -> bytes:
    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    rows = b"".join(b"\x00" + b"\x10\x20\x30" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def zip_bytes(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    return out.getvalue()


def tar_bytes(mode: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as archive:
        folder = tarfile.TarInfo("dir")
        folder.type, folder.mode = tarfile.DIRTYPE, 0o755
        archive.addfile(folder)
        for name, perm in (("dir/inner.txt", 0o644), ("._junk", 0o600), ("run.sh", 0o4755)):
            info = tarfile.TarInfo(name)
            info.size, info.mode = 5, perm
            archive.addfile(info, io.BytesIO(b"hello"))
    return out.getvalue()


CELLS = {"cells": [{"cell_type": "code", "source": ["a", "b"]}, {"source": "c"}]}
W = '<w:document><w:body><w:p><w:t>First</w:t></w:p><w:p><w:t>Second</w:t></w:p></w:body></w:document>'


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    files: dict[str, bytes | str] = {
        "a.csv": "name,score\nalpha\nbeta,2,extra\n\"q,1\",3\n",
        "bad.json": "{nope",
        "good.json": '{"b": 1, "a": [true]}',
        "s.ini": "[b]\nk=v\n[a]\nx=1\n",
        "bad.zip": b"PK\x03\x04 broken",
        "t.zip": zip_bytes({"k/m/deep.txt": "hello", "k/side.txt": "x", "__MACOSX/a": "n", "._q": "n"}),
        "t.tar": tar_bytes("w"),
        "t.tar.gz": tar_bytes("w:gz"),
        "cut.tar": tar_bytes("w")[:1600],
        "lone.gz": gzip.compress(b"text"),
        "d.docx": zip_bytes({"word/document.xml": W}),
        "o.odt": zip_bytes({"content.xml": "<o><p>odt text</p></o>"}),
        "empty.docx": zip_bytes({"other.xml": "<x/>"}),
        "s.pptx": zip_bytes({
            "ppt/slides/slide2.xml": "<s><t>Two</t></s>", "ppt/slides/slide1.xml": "<s><t>One</t></s>",
            "ppt/other.xml": "<x>no</x>",
        }),
        "b.epub": zip_bytes({"c1.xhtml": "<p>Chapter <b>one</b></p>", "c2.xhtml": "<p>Two</p>", "x.css": "p{}"}),
        "spine.epub": zip_bytes({
            "OPS/b.html": "<h1>Second</h1><p>x</p>", "OPS/a 1.xhtml": "<p>First</p>", "OPS/nav.xhtml": "nav",
            "OPS/p.opf": '<package><manifest><item id="i1" href="a%201.xhtml"/><item href="b.html" id="i2"/>'
            '<item id="i1" href="dup.xhtml"/><item id="n" href="nav.xhtml"/></manifest><spine>'
            '<itemref idref="i1"/><itemref idref="i2"/><itemref idref="gone"/></spine></package>',
        }),
        "100%.txt": "per cent",
        "f.fb2": "<FictionBook><body><p>a short tale</p></body></FictionBook>",
        "z.fbz": zip_bytes({"book.FB2": "<b><p>packed</p></b>"}),
        "c.cbz": zip_bytes({"p1.jpg": "xx", "._p": "n", "dir/": ""}),
        "n.ipynb": json.dumps(CELLS),
        "m.eml": "From: a@b.c\nTo: d\nSubject: hi\n\nbody\n",
        "i.png": png(3, 2),
        "r.rtf": "{\\rtf1 raw}",
        "p.md": "# Title\n\nHello.\n",
        "x.bin": b"\x00\x02RAWBYTES",
        "plain.txt": "hello plain",
        "latin.py": b"caf\xe9",
        "old.doc": b"\xd0\xcf\x11\xe0" + b"\x00" * 8 + b"Recovered words of a letter" + b"\x00",
        "old.ppt": b"\xd0\xcf\x11\xe0",
        "noext": b"%PDF-1.4 \xff",
        "sub/deep/leaf.txt": "leaf",
        "sub/.hidden": "h",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode() if isinstance(content, str) else content)
    return root


def names(df, column="path"):
    return {r[column].rsplit("/", 1)[-1] for r in df.collect()}


def test_scan(spark, corpus):
    files = S.scan_files(spark, str(corpus))
    assert files.count() == 32  # Spark's file listing leaves out hidden files
    assert names(S.scan_files(spark, str(corpus), "*.md")) == {"p.md"}
    listed = {r["path"].rsplit("/", 1)[-1]: r["length"] for r in files.select("path", "length").collect()}
    assert listed["plain.txt"] == 11
    assert S.oversize_files(files).count() == 0
    assert "LessThanOrEqual(length," in S.readable_files(files)._jdf.queryExecution().toString()


def test_lines_in_the_order_given(spark, corpus, tmp_path):
    (tmp_path / "one two+3%.txt").write_text("b\r\na\n\nz")
    paths = [str(corpus / "plain.txt"), str(tmp_path / "one two+3%.txt")]
    rows = S.read_lines(spark, paths[::-1]).orderBy("file_no", "line_no").collect()
    assert [(r["file_no"], r["line_no"], r["line"]) for r in rows] == [
        (1, 1, "b\r"), (1, 2, "a"), (1, 3, ""), (1, 4, "z"), (2, 1, "hello plain")
    ]


def test_a_file_given_twice_comes_twice(spark, corpus):
    path = str(corpus / "plain.txt")
    rows = S.read_lines(spark, [path, path]).orderBy("file_no").collect()
    assert [(r["file_no"], r["line"]) for r in rows] == [(1, "hello plain"), (2, "hello plain")]


def test_line_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = S.read_lines(spark, [str(path)])
        wrong = lines.filter(F.col("line") != F.concat(F.lit("line "), F.col("line_no")))
        assert (lines.count(), wrong.count()) == (20000, 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ragged_delimited(spark, corpus):
    path = str(corpus / "a.csv")
    for multi_line in (True, False):
        body = S.read_delimited(spark, path, multi_line=multi_line).orderBy("start", "row_id")
        cells = [r["cells"] for r in body.collect()]
        assert cells == [["alpha"], ["beta", "2", "extra"], ["q,1", "3"]]
    assert S.delimited_headers(spark, path).collect()[0]["headers"] == ["name", "score"]
    split = S.delimited_headers(spark, path, multi_line=False).collect()
    assert split[0]["headers"] == ["name", "score"]
    with_header = S.read_delimited(spark, path, header=False).orderBy("row_id").collect()
    assert with_header[0]["cells"] == ["name", "score"]


@pytest.mark.parametrize("split", [7, 40, 10_000])
def test_delimited_records_across_splits(spark, tmp_path, split):
    pick = random.Random(split)
    want = {}
    for i in range(12):
        text = "".join(pick.choice(["a", '"', '"', ",", "\n", "\r\n", '""', "é", 'x"y', ',"b\nc",', "\n\n"])
                       for _ in range(pick.randrange(60)))
        (tmp_path / f"f{i}.csv").write_bytes(text.encode())
        want[f"f{i}.csv"] = model_records(text)
    (tmp_path / "open.csv").write_text('h\n"' + "never closed\n" * 40)
    want["open.csv"] = [["h"], ["never closed\n" * 39 + "never closed"]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        body = S.read_delimited(spark, str(tmp_path), header=False).orderBy("path", "start", "row_id").collect()
        rest = S.read_delimited(spark, str(tmp_path)).orderBy("path", "start", "row_id").collect()
        heads = {r["path"].rsplit("/", 1)[-1]: r["headers"] for r in S.delimited_headers(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, records in want.items():
        assert [r["cells"] for r in body if r["path"].endswith("/" + name)] == records
        assert [r["cells"] for r in rest if r["path"].endswith("/" + name)] == records[1:]
        assert heads.get(name) == (records[0] if records else None)


def model_records(text):
    """Fields are quoted when they start with a quote; what follows the closing quote stays."""
    records, cells, field = [], [], ""
    state = "start"
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if i == len(lines) - 1 and line == "" and state != "quoted":
            break
        if state != "quoted":
            if line in ("", "\r"):
                continue
            cells, field, state = [], "", "start"
        elif i == len(lines) - 1 and line == "":
            break  # the line feed at the end of a file ends its last line
        else:
            field += "\n"
        at, bare = 0, line
        while at < len(bare):
            c = bare[at]
            if state == "quoted" and bare[at : at + 2] == '""':
                field, at = field + '"', at + 2
                continue
            if state == "quoted" and c == '"':
                state = "after"
            elif state == "quoted":
                field += c
            elif c == ",":
                cells.append(field)
                field, state = "", "start"
            elif c == '"' and state == "start":
                state = "quoted"
            else:
                field, state = field + c, state if state == "after" else "plain"
            at += 1
        if state != "quoted":
            if field.endswith("\r") and bare.endswith("\r"):
                field = field[:-1]
            cells.append(field)
            records.append(cells)
    if state == "quoted":
        records.append([*cells, field.removesuffix("\r")])
    return records


def test_json_docs(spark, corpus):
    docs = S.read_json_docs(spark, [str(corpus / "bad.json"), str(corpus / "good.json")])
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in docs.withColumn("j", F.to_json("value")).drop("value").collect()}
    assert rows["good.json"]["j"] == '{"a":[true],"b":1}' and rows["good.json"]["error"] is None
    assert rows["bad.json"]["error"] == "invalid json" and rows["bad.json"]["raw"] == "{nope"


def test_oversize_json_is_found_without_reading_the_others(spark, corpus, monkeypatch):
    paths = [str(corpus / "bad.json"), str(corpus / "good.json")]
    assert S.read_json_docs(spark, paths).rdd.getNumPartitions() == 2  # one per file, none for too large ones
    monkeypatch.setattr(S, "MAX_CONTENT", (corpus / "bad.json").stat().st_size)
    errors = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in S.read_json_docs(spark, paths).collect()}
    assert errors == {"bad.json": "invalid json", "good.json": "file too large"}


def test_rows_of_one_task_are_written_as_files_by_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "FILES_PER_TASK", 10)
    rows = spark.range(0, 100, 1, 1).selectExpr("IF(id = 7, NULL, concat('a\n', id, 'ü')) AS value")
    for place in (tmp_path / "plain", tmp_path / "with scheme"):
        V.write_each(rows, str(place) if place.name == "plain" else f"file://{place}")
        files = [p for p in place.rglob("*") if p.is_file()]
        assert sorted(p.read_text() for p in files) == sorted(["\n", *(f"a\n{i}ü\n" for i in range(100) if i != 7)])
        assert len({p.parent for p in files}) == 10
    V.write_each(rows.limit(0), str(tmp_path / "none"))
    assert S.read_json_docs(spark, str(tmp_path / "none")).collect() == []


def test_parquet_preview(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr("id", "id / 2 AS half", "IF(id = 1, NULL, 'x') AS s").write.parquet(path)
    rows = S.read_parquet_preview(spark, path, order=["id"]).orderBy("row_no").collect()
    assert len(rows) == 20 and rows[0]["n_rows"] == 100
    assert rows[1]["cells"] == ["1", "0.5", "NULL"]
    assert rows[0]["columns"] == "id bigint, half double, s string"


def test_image_catalog(spark, corpus):
    rows = S.image_catalog(spark, str(corpus)).collect()
    assert [(r["width"], r["height"], r["n_channels"]) for r in rows] == [(3, 2, 3)]
    data = S.image_catalog(spark, str(corpus), pixels=True).collect()[0]["data"]
    assert len(data) == 18


def test_manifest(spark, corpus):
    files = S.scan_files(spark, str(corpus))
    rows = A.archive_manifest(files).collect()
    by_name: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["archive"], r["seq"] or 0)):
        by_name.setdefault(r["archive"].rsplit("/", 1)[-1], []).append(r)
    assert [(r["path"], r["size"], r["mode"]) for r in by_name["t.zip"]] == [
        ("k/m/deep.txt", 5, "-rw-r--r--"), ("k/side.txt", 1, "-rw-r--r--")
    ]
    for name in ("t.tar", "t.tar.gz"):
        assert [(r["path"], r["is_dir"], r["size"], r["mode"]) for r in by_name[name]] == [
            ("dir/", True, 0, "-rwxr-xr-x"),
            ("dir/inner.txt", False, 5, "-rw-r--r--"),
            ("run.sh", False, 5, "-rwxr-xr-x"),
        ]
    assert [(r["path"], r["mode"]) for r in by_name["lone.gz"]] == [("lone.gz", "-rw-r--r--")]
    for name in ("bad.zip", "cut.tar"):
        (row,) = by_name[name]
        assert row["error"].startswith("unreadable archive") and row["path"] is None
    assert len(A.archive_manifest(files, max_entries=1).filter("error IS NULL").collect()) == 4


def test_members(spark, corpus):
    found = A.zip_member_text(S.scan_files(spark, str(corpus))).collect()
    texts = {(r["path"].rsplit("/", 1)[-1], r["member"]): r["text"] for r in found if r["member"]}
    assert texts[("o.odt", "content.xml")] == "<o><p>odt text</p></o>"
    assert ("z.fbz", "book.FB2") in texts and ("b.epub", "c2.xhtml") in texts
    slides = sorted((r["seq"], r["member"]) for r in found if r["path"].endswith("s.pptx"))
    assert [m for _, m in slides] == ["ppt/slides/slide2.xml", "ppt/slides/slide1.xml"]
    errors = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in found if r["error"]}
    assert errors == {"empty.docx": "no matching member"}


@pytest.fixture(scope="module")
def previews(spark, corpus):
    rows = P.preview_files(spark, str(corpus)).collect()
    return {r["id"].rsplit("/", 1)[-1]: r for r in rows}


@pytest.mark.parametrize(
    ("name", "kind", "shape", "text"),
    [
        ("a.csv", "data", "table", "name\tscore\nalpha\nbeta\t2\textra\nq,1\t3\n"),
        ("good.json", "data", "text", '{"a":[true],"b":1}'),
        ("bad.json", "data", "text", "{nope"),
        ("s.ini", "data", "text", "[a]\nx = 1\n\n[b]\nk = v\n\n"),
        ("d.docx", "document", "text", "First \n\nSecond "),
        ("o.odt", "document", "text", "odt text\n"),
        ("s.pptx", "presentation", "slides", "Two\n\n\n---\n\nOne\n"),
        ("b.epub", "ebook", "text", "Chapter one\n\nTwo\n\n"),
        ("spine.epub", "ebook", "text", "First\n\nSecond\nx\n\n"),
        ("100%.txt", "fallback", "text", "per cent"),
        ("f.fb2", "ebook", "text", "a short tale\n"),
        ("z.fbz", "ebook", "text", "packed\n"),
        ("c.cbz", "ebook", "text", "Comic book archive — 3 file(s)\n\np1.jpg (2 bytes)\ndir/\n"),
        ("n.ipynb", "notebook", "slides", "## Cell 1 (code)\n\nab\n\n---\n\n## Cell 2 (cell)\n\nc"),
        ("m.eml", "email", "text", "From: a@b.c\nTo: d\nSubject: hi\n\nbody\n"),
        ("r.rtf", "document", "text", "{\\rtf1 raw}"),
        ("p.md", "markdown", "markdown", "# Title\n\nHello.\n"),
        ("plain.txt", "fallback", "text", "hello plain"),
        ("old.doc", "legacy_office", "text", "Recovered words of a letter\n"),
        ("t.zip", "archive", "tree",
         "    └── k\n        ├── m\n        │   └── deep.txt (5 B) -rw-r--r--\n        └── side.txt (1 B) -rw-r--r--\n"),
    ],
)
def test_preview_texts(previews, name, kind, shape, text):
    row = previews[name]
    assert (row["kind"], row["shape"], row["text"]) == (kind, shape, text)
    assert row["n_chars"] == len(text) and not row["truncated"]


def test_preview_of_bytes(previews):
    row = previews["x.bin"]
    assert (row["kind"], row["shape"]) == ("fallback", "hex")
    assert "size: 10 bytes\nmime: unknown\n00000000  00 02 52" in row["text"]
    assert previews["latin.py"]["shape"] == "hex" and previews["latin.py"]["kind"] == "code"
    assert (previews["noext"]["kind"], previews["noext"]["shape"]) == ("pdf", "hex")
    assert "mime: application/pdf" in previews["noext"]["text"]
    assert previews["empty.docx"]["shape"] == "hex"


def test_bad_items_are_rows(previews):
    assert previews["bad.json"]["error"] == "invalid json"
    assert previews["bad.zip"]["shape"] == "unsupported"
    assert previews["i.png"]["shape"] == "unsupported" and previews["i.png"]["kind"] == "image"
    legacy = previews["old.ppt"]
    assert legacy["shape"] == "unsupported" and legacy["error"].startswith("Legacy Office file:")
    assert legacy["text"].endswith("(docx/xlsx/pptx).")


def test_titles_and_trees(previews, corpus):
    assert previews["p.md"]["title"] == "p.md"
    assert previews["t.zip"]["title"].startswith("Archive: ")
    tree = previews[corpus.name]
    assert tree["title"] == f"Directory: {corpus}"
    assert "    ├── sub drwxr-xr-x\n    │   └── deep drwxr-xr-x\n" in tree["text"]
    assert ".hidden" not in tree["text"]
    assert len(previews) == 32 + 1  # every listed file, and the directory


def test_limits_apply(spark):
    rows = [(1, "a.md", False, 10, "x" * 50), (2, "d", True, None, None)]
    df = spark.createDataFrame(rows, "id int, path string, is_dir boolean, size long, content string")
    got = {r["id"]: r for r in P.preview_corpus(df, Limits(text_chars=20)).collect()}
    assert got[1]["text"] == "x" * 20 + "\n…" and got[1]["truncated"] and got[1]["n_chars"] == 50
    assert got[2]["kind"] == "directory" and got[2]["shape"] == "tree"
    whole = {r["id"]: r for r in P.preview_corpus(df, Limits(text_chars=0)).collect()}
    assert whole[1]["text"] == "x" * 50


def test_cuts_are_told(spark):
    csv = "a,b\n" + "1,2\n" * 900
    xml = "<b>" + "<p>x</p>" * 6000 + "</b>"
    rows = [("t.csv", csv), ("t.fb2", xml), ("t.xyz", "y" * 100_000), ("t.bin", "é" * 50_000), ("t.md", "z" * 9000)]
    df = spark.createDataFrame(
        [(p, p, False, len(t), t) for p, t in rows], "id string, path string, is_dir boolean, size long, content string"
    )
    cut = {r["id"]: r for r in P.preview_corpus(df).collect()}
    assert {k: r["truncated"] for k, r in cut.items()} == {
        "t.csv": True, "t.fb2": True, "t.xyz": True, "t.bin": True, "t.md": False}
    whole = {r["id"]: r for r in P.preview_corpus(df, UNCUT).collect()}
    assert not any(r["truncated"] for r in whole.values())
    assert whole["t.csv"]["text"].count("\n") == 901 and whole["t.fb2"]["text"] == "x\n" * 6000
    assert whole["t.xyz"]["n_chars"] == 100_000 and whole["t.bin"]["text"].count("|\n") == 6250


def test_one_bad_record_or_member_is_one_row(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("a,b\n" + ",".join("1" * 30_000) + "\nx,y\n")
    rows = S.read_delimited(spark, str(tmp_path / "wide.csv")).collect()
    assert sorted(len(r["cells"]) for r in rows) == [2, 30_000]
    deck = {"ppt/slides/slide1.xml": b"<t>\xff</t>", "ppt/slides/slide2.xml": b"<t>good</t>"}
    (tmp_path / "s.pptx").write_bytes(zip_bytes(deck))
    got = A.zip_member_text(S.scan_files(spark, str(tmp_path), "*.pptx")).orderBy("seq").collect()
    assert got[0]["text"] is None and got[0]["error"].startswith("unreadable member")
    assert got[1]["text"] == "<t>good</t>" and got[1]["error"] is None


def test_extractors_come_first(spark):
    own = P.Extractors()
    P.register_extractor(own, "markdown", lambda text, content: F.when(F.length(text) > 3, F.upper(text)))
    own.register("mine", lambda text, content: F.concat(F.lit("got "), F.length(content)), ["abc"])
    rows = [("a.md", "long text"), ("b.md", "hi"), ("c.abc", "12345"), ("d.xyz", "plain")]
    df = spark.createDataFrame(
        [(p, p, False, 1, t) for p, t in rows], "id string, path string, is_dir boolean, size long, content string"
    )
    got = {r["id"]: (r["kind"], r["text"]) for r in P.preview_corpus(df, extractors=own).collect()}
    assert got == {
        "a.md": ("markdown", "LONG TEXT"), "b.md": ("markdown", "hi"),
        "c.abc": ("mine", "got 5"), "d.xyz": ("fallback", "plain"),
    }


def test_pandas_extractor(spark):
    @F.pandas_udf("string")
    def shout(text: pd.Series) -> pd.Series:
        return text.str.upper()

    own = P.Extractors()
    own.register("code", lambda text, content: shout(text))
    df = spark.createDataFrame([(1, "a.py", False, 1, "x")], "id int, path string, is_dir boolean, size long, content string")
    assert P.preview_corpus(df, extractors=own).collect()[0]["text"] == "X"


def test_write_previews(spark, corpus, tmp_path):
    rows = P.preview_files(spark, str(corpus))
    S.write_previews(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == rows.count()
    assert (tmp_path / "out" / "kind=markdown").is_dir()
    S.write_previews(rows, str(tmp_path / "compact"), compact=True)
    assert spark.read.parquet(str(tmp_path / "compact")).count() == rows.count()
    assert len(list((tmp_path / "compact" / "kind=data").glob("*.parquet"))) == 1
    S.write_preview_text(rows, str(tmp_path / "text"))
    assert "Hello." in [r[0] for r in spark.read.text(str(tmp_path / "text/kind=markdown")).collect()]


def test_stream(spark, corpus, tmp_path):
    stream = ST.preview_stream(ST.stream_files(spark, str(corpus), files_per_batch=7))
    query = ST.write_preview_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r["id"].rsplit("/", 1)[-1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["d.docx"]["text"] == "First \n\nSecond "
    assert got["a.csv"]["kind"] == "data" and got["x.bin"]["shape"] == "hex"
    batch = P.preview_files(spark, str(corpus))
    same = {r["id"].rsplit("/", 1)[-1]: r["text"] for r in batch.collect()}
    plain = [n for n in got if got[n]["kind"] not in ("archive",) and n != "c.cbz"]
    assert all(got[n]["text"] == same[n] for n in plain)


def test_stateless_columns_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("<p>x</p>\n")
    lines = spark.readStream.text(str(tmp_path / "in"))
    out = lines.select(T.strip_tags(F.col("value")).alias("t"), T.truncate_chars(F.col("value"), 2).alias("c"))
    query = out.writeStream.format("memory").queryName("stateless").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("stateless").collect()] == [("x", "<p\n…")]


def test_preview_is_one_narrow_stage(spark):
    df = spark.createDataFrame([(1, "a.md", False, 1, "x")], "id int, path string, is_dir boolean, size long, content string")
    plan = P.preview_corpus(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_archive_tree_is_bounded(spark, corpus):
    nodes = TR.build_nodes(A.manifest_entries(A.archive_manifest(S.scan_files(spark, str(corpus)))))
    assert {r["tree_id"].rsplit("/", 1)[-1]: r["n_nodes"] for r in TR.count_nodes(nodes).collect()} == {
        "t.zip": 5, "t.tar": 4, "t.tar.gz": 4, "lone.gz": 2
    }


def test_containers_go_through_python_in_groups(spark, monkeypatch):
    """However many rows come at once, what is made of them goes on in groups of bounded size."""
    texts = ["\n".join(f"line {i} {j}" for j in range(20)) for i in range(40)]
    for module in (V, A):
        monkeypatch.setattr(module, "GROUP_BYTES", 20_000)
    lit = lambda value: pa.array([value] * 40, pa.string())
    packed = list(V._packer().func(iter([(pa.array(texts), lit("zip"))])))
    assert len(packed) > 3 and max(p.nbytes for p in packed) < 30_000
    content = pa.concat_arrays(packed)
    assert [len(p) for p in A._container_reader().func(iter([]))] == []
    reader = A._container_reader().func
    once = pa.array([False] * 40)
    docs = list(reader(iter([(content, lit(r"lines/.*"), once, lit(None))])))
    trees = list(reader(iter([(content, lit(None), once, lit("zip"))])))
    assert len(docs) > 1 and len(trees) > 3
    found = [[m["text"] for m in row["members"]] for group in docs for row in group.to_pylist()]
    assert found == [t.split("\n") for t in texts]
    assert [len(row["entries"]) for group in trees for row in group.to_pylist()] == [23] * 40
