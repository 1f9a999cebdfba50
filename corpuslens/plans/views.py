"""Views over the given tables that carry the shapes the operators work on.

Every view is one narrow projection of a table, so it grows with it. The matching SQL is in
:mod:`corpuslens.plans.oracle`.
"""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.archives import GROUP_BYTES
from corpuslens.sources.files import plain_path

# Extensions given to documents by ``doc_id`` modulo the length of the list.
EXTENSIONS: tuple[str, ...] = (
    "md", "txt", "HTML", "py", "json", "csv", "ini", "eml", "ipynb", "pdf", "tar.gz", "", "xls",
    "svg", "zzz", "doc", "fb2", "opf", "tsv", "yaml", "PNG", "mp3", "rtf", "docx", "zip", "xml",
    "sqlite", "ttf", "cbz", "nb9", "7z", "plist",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILES_PER_TASK = 2_000


def write_each(rows: DataFrame, path: str) -> None:
    """Every row of one text column as a file of its own, closed by a line feed, in a folder per task;
    as many tasks as the number of files asks for.

    Where the folder is mounted, tasks write with the system's own calls: Hadoop's local file system
    starts a process per file to set its permissions. Elsewhere Spark's writer is used, and each task
    moves its files to their place itself, which else the driver does, one after the other.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    spread = rows.repartition(max(cores, -(-rows.count() // FILES_PER_TASK)))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    if place.startswith("file:"):
        os.makedirs(plain_path(place), exist_ok=True)
        spread.mapInArrow(_file_writer(plain_path(place)), "n bigint").agg(F.sum("n")).first()
    else:
        writer = spread.write.option("maxRecordsPerFile", 1)
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)


def _file_writer(root: str):
    """Function that writes the files of a task. A file gets its name when it is whole, so that a
    repeated task only replaces files by their like."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        folder = f"{root}/part-{task.partitionId():05d}"
        os.makedirs(folder, exist_ok=True)
        begun, n = f"{folder}/.{task.taskAttemptId()}", 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                with open(begun, "wb") as out:
                    out.write((value or "").encode() + b"\n")
                os.replace(begun, f"{folder}/{n:09d}.txt")
                n += 1
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    return write


def document_ext() -> Column:
    """Extension a document gets in the listing."""
    names = F.array(*[F.lit(e) for e in EXTENSIONS])
    return F.get(names, (F.col("doc_id") % len(EXTENSIONS)).cast("int"))


def document_path() -> Column:
    """Path a document gets: hidden, noise, deep and directory cases by ``doc_id``."""
    n = F.col("doc_id")
    ext = document_ext()
    name = F.concat(
        F.when(n % 37 == 5, ".").otherwise(""),
        F.when(n % 41 == 7, "._").otherwise(""),
        F.lit("doc"),
        n.cast("string"),
        F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""),
    )
    return F.concat(
        F.col("lang"),
        F.lit("/b"),
        (n % 7).cast("string"),
        F.when(n % 5 == 0, "/deep/er").otherwise(""),
        F.when(n % 53 == 11, "/__MACOSX").otherwise(""),
        F.lit("/"),
        F.when(n % 29 == 3, F.concat(F.lit("Sub"), n.cast("string"))).otherwise(name),
    )


def document_listing(documents: DataFrame) -> DataFrame:
    """Documents as file entries ``(id, tree_id, seq, path, is_dir, size, mode)``."""
    is_dir = F.col("doc_id") % 29 == 3
    return documents.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("tree_id"),
        F.col("doc_id").alias("seq"),
        document_path().alias("path"),
        is_dir.alias("is_dir"),
        F.when(~is_dir, F.col("n_chars")).alias("size"),
        F.when(is_dir, "drwxr-xr-x").otherwise("-rw-r--r--").alias("mode"),
    )


def _put(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _json_text(text: Column) -> Column:
    """A text as a JSON string."""
    quoted = F.to_json(F.struct(text.alias("v")))
    return F.substr(quoted, F.lit(6), F.length(quoted) - 6)


def _each_line(lines: Column, render) -> Column:
    return F.array_join(F.transform(lines, render), "")


def document_files(documents: DataFrame, containers: bool = True) -> DataFrame:
    """Documents as files ``(id, path, is_dir, size, content, entries)``; the content holds the whole
    text in a form that fits the kind, directories list a file per line. Without ``containers`` the
    content of zip and tar files is the plain text."""
    n, text = F.col("doc_id"), F.col("text")
    word = n.cast("string")
    ext = document_ext()
    lines, plain = F.split(text, "\n", -1), plain_lines(text)
    number = lambda i: (i + 1).cast("string")

    notebook = F.to_json(
        F.struct(
            F.array(
                F.struct(F.lit("markdown").alias("cell_type"), F.lit("# doc").alias("source")),
                F.struct(F.lit(None).cast("string").alias("cell_type"), text.alias("source")),
            ).alias("cells")
        )
    )
    quoted = lambda line: F.concat(F.lit('"'), F.replace(line, F.lit('"'), F.lit('""')), F.lit('"'))
    content = (
        F.when(
            ext == "json",
            F.when(n % 3 == 0, _put('{"id": ', word, ', "text": ', _json_text(text))).otherwise(
                _put('{"text": ', _json_text(text), ', "lang":"', F.col("lang"), '", "id":', word, "}")
            ),
        )
        .when(
            ext == "csv",
            _put("doc,lang\n", _each_line(lines, lambda l, i: _put(number(i), ",", quoted(l), ",x\n"))),
        )
        .when(ext == "tsv", _put("doc\tlang\n", _each_line(plain, lambda l, i: _put(number(i), "\t", l, "\n"))))
        .when(ext == "ini", ini_text(plain))
        .when(
            ext == "eml",
            _put("From: ", F.col("source"), "@example.org\r\nTo: list\r\nSubject: doc\r\n  ", word, "\r\n\r\n", text),
        )
        .when(ext == "ipynb", notebook)
        .when(
            ext == "pdf",
            F.when(n % 64 == 9, _put("%PDF-1.4\n", text)).otherwise(
                F.replace(text, F.lit("\n"), F.lit("\f"))
            ),
        )
        .when(ext == "", F.when(n % 64 == 11, _put("GIF89a", text)).otherwise(_put("%PDF-", text)))
        .when(
            ext == "fb2",
            _put(
                '<?xml version="1.0"?><FictionBook><body><p>',
                F.replace(text, F.lit("\n"), F.lit("</p>\n<p>")),
                "</p></body></FictionBook>",
            ),
        )
        .when(
            ext == "opf",
            _put(
                "<package><title>", word, "</title><!-- ", F.col("lang"), " -->",
                _each_line(plain, lambda l, i: _put("<d>", l, "</d>")), "</package>",
            ),
        )
        .otherwise(text)
    )
    content = F.encode(content, "utf-8")
    if containers:
        form = F.when(ext.isin("zip", "cbz", "docx"), "zip").when(ext == "tar.gz", "tar")
        packed = _packer()(F.when(form.isNotNull(), F.translate(text, "&<>", "+++")), form)
        content = F.when(form.isNotNull(), packed).otherwise(content)
    is_dir = F.col("doc_id") % 29 == 3
    listing = F.transform(
        plain,
        lambda l, i: F.struct(
            i.cast("bigint").alias("seq"),
            _put("d", (i % 3).cast("string"), "/", l, ".txt").alias("path"),
            F.lit(False).alias("is_dir"),
            F.length(l).cast("bigint").alias("size"),
            F.lit(None).cast("string").alias("mode"),
        ),
    )
    return documents.select(
        F.col("doc_id").alias("id"),
        document_path().alias("path"),
        is_dir.alias("is_dir"),
        F.when(~is_dir, F.col("n_chars")).alias("size"),
        F.when(~is_dir, content).alias("content"),
        F.when(is_dir, listing).alias("entries"),
    )


def rule_table(documents: DataFrame) -> DataFrame:
    """``(name, extensions, mime)``: a rule per document, some with an extension or a pattern."""
    n = F.col("doc_id")
    patterns = (("image/",), ("application/*", "x"), ("text/html",), ("image/gif",))
    mime = F.lit(None).cast("array<string>")
    for i, group in enumerate(patterns):
        mime = F.when(n % 97 == 50 + i, F.array(*map(F.lit, group))).otherwise(mime)
    return documents.select(
        F.when(n % 101 == 7, "markdown").otherwise(F.concat(F.lit("r"), F.lpad(n.cast("string"), 9, F.lit("0")))).alias("name"),
        F.when(n % 11 == 3, F.array(F.upper(document_ext()), F.lit("none"))).alias("extensions"),
        mime.alias("mime"),
    )


def url_entries(pages: DataFrame) -> DataFrame:
    """Pages as entries of one tree per host; query and fragment cut off."""
    path = F.regexp_extract("url", r"\Ahttps?://[^/]+/([^?#]*)", 1)
    return pages.select(
        F.regexp_extract("url", r"\Ahttps?://([^/]+)", 1).alias("tree_id"),
        F.col("page_id").alias("seq"),
        path.alias("path"),
        F.endswith(path, F.lit("/")).alias("is_dir"),
        F.length("html").cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("mode"),
    )


def plain_lines(text: Column) -> Column:
    """Lines of a text reduced to ASCII letters, digits and single spaces; empty ones dropped."""
    kept = F.regexp_replace(F.translate(text, "_", ""), r"[^\w \n]+", "")
    kept = F.regexp_replace(kept, "  +", " ")
    lines = F.transform(F.split(kept, "\n", -1), lambda l: F.trim(l))
    return F.filter(lines, lambda l: l != "")


def markdown_docs(documents: DataFrame) -> DataFrame:
    """``(id, text)``: a markdown text per document with headings, lists, fences and a table."""
    word = F.col("doc_id").cast("string")
    lines = plain_lines(F.col("text"))

    def each(fn) -> Column:
        return F.array_join(F.transform(F.col("lines"), fn), "")

    text = F.concat(
        F.lit("# Doc **"), word, F.lit("** `a*b*`\n\n"),
        each(lambda l, i: F.concat(F.lit("- "), l, F.lit("\n"), F.when(i % 3 == 1, "  - *in* _it_\n").otherwise(""))),
        F.lit("\n"),
        each(lambda l, i: F.concat((i * 2 + 5).cast("string"), F.lit(". "), l, F.lit("\n"))),
        F.lit("\n```sql\n# not a heading\n"),
        each(lambda l: F.concat(l, F.lit("\n"))),
        F.lit("```\n\n| line | size |\n| :--- | ---: |\n"),
        each(lambda l, i: F.concat(F.lit("| "), l, F.when(i % 4 == 2, "").otherwise(F.concat(F.lit(" | "), F.length(l).cast("string"))), F.lit(" |\n"))),
        F.lit("\n## [End](http://example.org/"), word, F.lit(") ![alt](p.png)\n\n~~~\n \n~~~\n"),
    )
    return documents.select(
        F.col("doc_id").alias("id"), "doc_id", lines.alias("lines")
    ).select("id", text.alias("text"))


def nested_markdown(documents: DataFrame) -> DataFrame:
    """``(id, text)``: every line as an underlined heading, a quoted one, one in two quotes, or as code."""
    lines = F.transform(
        plain_lines(F.col("text")),
        lambda l, i: F.when(i % 4 == 0, F.concat(l, F.lit("\n====\n\n")))
        .when(i % 4 == 1, F.concat(F.lit("> ## "), l, F.lit("\n\n")))
        .when(i % 4 == 2, F.concat(F.lit("> > "), l, F.lit("\n> > ---\n\n")))
        .otherwise(F.concat(F.lit("      "), l, F.lit("\n\n"))),
    )
    return documents.select(F.col("doc_id").alias("id"), F.array_join(lines, "").alias("text"))


def linked_markdown(documents: DataFrame) -> DataFrame:
    """``(id, text)``: every line as a list item with a link, an image and a name by reference, the
    definitions behind them; every fifth one has none."""
    items = F.transform(
        plain_lines(F.col("text")),
        lambda l, i: F.concat(
            F.lit("- ["), l, F.lit("][No"), (i % 5).cast("string"), F.lit("] ![pic][no2] [No  1][] [no3] `[no3]`\n")
        ),
    )
    ends = "\n[no0]: http://e.org/0\n [NO1]: <x> 'title one'\n\n[no2]: p.png \"Two\"\n[no 1]: y\n[no3]: z\n```\n[no4]: no\n```\n"
    return documents.select(
        F.col("doc_id").alias("id"), F.concat(F.array_join(items, ""), F.lit(ends)).alias("text")
    )


def mail_messages(conversations: DataFrame) -> DataFrame:
    """``(id, raw)``: a message per turn in one of nine forms: plain, HTML, base64, quoted-printable,
    multipart with an attachment first, nested multipart with HTML first, HTML alone in a part in a
    western charset, a western body, and an image without text."""
    n = F.col("conv_id") + F.col("turn")
    text = F.col("text")
    crlf = F.replace(text, F.lit("\n"), F.lit("\r\n"))
    encoded = F.base64(F.encode(text, "utf-8"))
    folded = F.regexp_replace(encoded, "(.{76})", "$1\n")
    escaped = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit(" ")), F.lit("%"), F.lit("="))
    soft = F.regexp_replace(escaped, "((?:=..|[^=]){40})", "$1=\n")
    form = (
        F.when(n % 9 == 0, _put("\n", text))
        .when(n % 9 == 1, _put("Content-Type: text/html; charset=utf-8\n\n<p>", text, "</p>"))
        .when(n % 9 == 2, _put("Content-Type: text/plain; charset=UTF-8\nContent-Transfer-Encoding: base64\n\n", folded, "\n"))
        .when(n % 9 == 3, _put("content-type: text/plain;\n charset=\"utf-8\"\ncontent-transfer-encoding: Quoted-Printable\n\n", soft))
        .when(
            n % 9 == 4,
            _put(
                "Content-Type: multipart/mixed; boundary=x+1\n\nfor old readers\n--x+1\nContent-Type: text/plain\n"
                "Content-Disposition: attachment; filename=a.txt\n\nnot me\n--x+1\n\n", text, "\n--x+1--\nepilogue\n",
            ),
        )
        .when(
            n % 9 == 5,
            _put(
                "Content-Type: multipart/mixed;\r\n\tboundary=\"out (er)\"\r\n\r\n--out (er)\r\n"
                "Content-Type: multipart/alternative; boundary=in\r\n\r\n--in\r\nContent-Type: text/html\r\n\r\n<b>no</b>\r\n"
                "--in  \r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n",
                F.replace(folded, F.lit("\n"), F.lit("\r\n")),
                "\r\n--in--\r\n--out (er)\r\nContent-Type: image/png\r\n\r\nPNG\r\n--out (er)--\r\n",
            ),
        )
        .when(
            n % 9 == 6,
            _put(
                "Content-Type: multipart/related; boundary=r\r\n\r\n--r\r\nContent-Type: text/html; charset=windows-1252\r\n"
                "Content-Transfer-Encoding: quoted-printable\r\n\r\n<p>=80 caf=E9=\r\n ", F.regexp_replace(crlf, r"[^\x00-\x7F]|=", "?"), "</p>\r\n--r--\r\n",
            ),
        )
        .when(n % 9 == 7, "Content-Type: text/plain; charset=ISO-8859-1\nContent-Transfer-Encoding: quoted-printable\n\n=FCber=20=\n")
        .otherwise("Content-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA\n")
    )
    subject = F.when(
        n % 2 == 0,
        _put("=?UTF-8?B?", F.base64(F.encode(F.lit("tür "), "utf-8")), "?= =?iso-8859-1?q?=E0_n=B0?=\n\t", F.col("turn").cast("string")),
    ).otherwise(_put("turn\n\t", F.col("turn").cast("string")))
    return conversations.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        _put(
            "From: ", F.col("role"), "@example.org\nTO: conv", F.col("conv_id").cast("string"), "\nSubject: ",
            subject, "\n", form,
        ).alias("raw"),
    )


def notebooks(conversations: DataFrame) -> DataFrame:
    """``(id, text)``: a notebook per turn; the source is one string or an array of lines."""
    n = F.col("conv_id") + F.col("turn")
    quoted = F.to_json(F.struct(F.col("text").alias("v")))
    one = F.substr(quoted, F.lit(6), F.length(quoted) - 6)
    listed = F.to_json(F.split("text", "\n", -1))
    return conversations.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.when(n % 7 == 6, F.concat(F.lit("{not json "), F.col("text")))
        .otherwise(
            F.concat(
                F.lit('{"cells":[{"cell_type":"'), F.col("role"), F.lit('","source":'),
                F.when(n % 2 == 0, one).otherwise(listed),
                F.lit('},{"source":"end"}]}'),
            )
        )
        .alias("text"),
    )


def ini_text(lines: Column) -> Column:
    """An ini text; every line of a text gives one key."""
    keys = _each_line(
        lines,
        lambda l, i: F.concat(
            F.when(i % 4 == 0, F.concat(F.lit("[s"), (i % 3).cast("string"), F.lit("]\n; note\n"))).otherwise(""),
            F.lit("k"), (i % 5).cast("string"), F.when(i % 6 == 5, "").otherwise(F.concat(F.lit(" = "), l)),
            F.lit("\n"),
        ),
    )
    return F.concat(F.lit("top=1\n"), keys)


def ini_files(documents: DataFrame) -> DataFrame:
    """``(id, text)``: an ini text per document."""
    return documents.select(
        F.col("doc_id").alias("id"), ini_text(plain_lines(F.col("text"))).alias("text")
    )


def paged_docs(documents: DataFrame) -> DataFrame:
    """``(id, text)``: a form feed in place of every third line feed."""
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda l, i: F.concat(F.when(i == 0, "").when(i % 3 == 0, " \f\n ").otherwise("\n"), l),
    )
    return documents.select(F.col("doc_id").alias("id"), F.array_join(lines, "").alias("text"))


def image_files(documents: DataFrame) -> DataFrame:
    """``(path, content)``: documents as image files of a size given by length and id; the text
    stands in comments before a JPEG frame, elsewhere behind the header."""
    n = F.col("doc_id")
    width, height = F.col("n_chars") % 5000 + 1, n % 3000 + 1

    def big(value: Column, size: int) -> Column:
        return F.lpad(F.hex(value), 2 * size, F.lit("0"))

    def little(value: Column, size: int) -> Column:
        digits = big(value, size)
        return F.concat(*(F.substring(digits, 2 * i - 1, 2) for i in range(size, 0, -1)))

    comments = F.transform(
        F.regexp_extract_all("text", F.lit("(?s).{1,9000}"), F.lit(0)),
        lambda c: _put("FFFE", big(F.octet_length(c) + 2, 2), F.hex(F.encode(c, "utf-8"))),
    )
    jpeg = _put("FFD8", F.array_join(comments, "FF"), "FFC40004AAAAFFC2001108", big(height, 2), big(width, 2), "03FFD9")
    head = (
        F.when(n % 8 == 0, _put("89504E470D0A1A0A0000000D49484452", big(width, 4), big(height, 4)))
        .when(n % 8 == 1, _put("474946383961", little(width, 2), little(height, 2)))
        .when(n % 8 == 2, _put("424D000000000000000000000000", "28000000", little(width, 4), little(2**32 - height, 4)))
        .when(n % 8 == 3, jpeg)
        .when(n % 8 == 4, _put("524946460000000057454250565038580A00000000000000", little(width - 1, 3), little(height - 1, 3)))
        .when(n % 8 == 5, _put("00000100010000", big(height % 256, 1)))
        .when(n % 8 == 6, "89504E470D0A1A0A0000")
    )
    content = F.concat(F.unhex(head), F.when(n % 8 == 6, F.lit(b"")).otherwise(F.encode("text", "utf-8")))
    return documents.select(
        F.concat(F.lit("img"), n.cast("string")).alias("path"),
        F.coalesce(content, F.encode("text", "utf-8")).alias("content"),
    )


def wide_docs(documents: DataFrame) -> DataFrame:
    """``(id, text)``: some letters as wide characters, one as a mark, a tab behind every comma."""
    text = F.translate("text", "wvkc", "漢Ａ\u0301🙂")
    return documents.select(
        F.col("doc_id").alias("id"), F.replace(text, F.lit(", "), F.lit(",\t")).alias("text")
    )


def magic_docs(documents: DataFrame) -> DataFrame:
    """``(id, content)``: every document behind the leading bytes of some format."""
    from corpuslens.functions.detect import MAGIC

    heads = [F.unhex(F.lit("00" * offset + digits)) for offset, digits, _ in MAGIC]
    pick = F.get(F.array(*heads), (F.col("doc_id") % (len(MAGIC) + 1)).cast("int"))
    return documents.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.concat(pick, F.encode("text", "utf-8")), F.encode("text", "utf-8")).alias("content"),
    )


def _packer():
    """Arrow UDF: a text becomes a zip or tar file with one member per line. Files go on in groups of
    some megabytes, however many texts come at once."""
    most = GROUP_BYTES

    def pack_zip(value: str, odt: bool) -> bytes:
        out = io.BytesIO()
        lines = value.split("\n")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            if odt:
                body = "".join(f"<text:p>{line}</text:p>" for line in lines)
                archive.writestr("mimetype", "application/vnd.oasis.opendocument.text")
                archive.writestr("content.xml", f"<?xml version='1.0'?><office:text>{body}</office:text>")
            else:
                body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in lines)
                archive.writestr("word/", "")
                archive.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
                archive.writestr("__MACOSX/word/x", "noise")
                for i, line in enumerate(lines):
                    archive.writestr(f"lines/l{i}.txt", line)
        return out.getvalue()

    def pack_tar(value: str) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as archive:
            for i, line in enumerate(value.split("\n")):
                data = line.encode()
                info = tarfile.TarInfo(f"part{i % 2}/l{i}.txt")
                info.size, info.mode = len(data), 0o640
                archive.addfile(info, io.BytesIO(data))
        return out.getvalue()

    def pack(value: str | None, form: str | None) -> bytes | None:
        if value is None or form is None:
            return None
        return pack_tar(value) if form == "tar" else pack_zip(value, form == "odt")

    def pack_all(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, form in batches:
            packed, size = [], 0
            for pair in zip(text, form):
                packed.append(pack(*(x.as_py() for x in pair)))
                size += len(packed[-1] or b"")
                if size >= most:
                    yield pa.array(packed, pa.binary())
                    packed, size = [], 0
            if packed:
                yield pa.array(packed, pa.binary())

    return F.arrow_udf(pack_all, "binary").asNondeterministic()


def zipped_docs(documents: DataFrame, ext: str) -> DataFrame:
    """``(path, length, content)``: a real zip file per document, one member per line of text."""
    packed = documents.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("." + ext)).alias("path"),
        _packer()(F.translate("text", "&<>", "+++"), F.lit("odt" if ext == "odt" else "zip")).alias("content"),
    )
    return packed.select("path", F.length("content").cast("bigint").alias("length"), "content")
