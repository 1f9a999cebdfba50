"""Registered queries: every operator over whole given tables, or over data derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.functions import detect as D
from corpuslens.functions import markdown as M
from corpuslens.functions import mail as ML
from corpuslens.functions import text as T
from corpuslens.limits import Limits
from corpuslens.operators import lines as L
from corpuslens.operators import markdown as MD
from corpuslens.operators import reports as R
from corpuslens.operators import rules as RL
from corpuslens.operators import tables as TB
from corpuslens.operators import trees as TR
from corpuslens.plans import preview as P
from corpuslens.plans import views as V
from corpuslens.limits import UNCUT
from corpuslens.plans.storage import work_dir
from corpuslens.registry import Rule
from corpuslens.sources import archives as A
from corpuslens.sources import files as S

Query = Callable[[SparkSession, str], DataFrame]

RULES = (
    Rule("zeta", ("zzz", "nb9"), ("text/html",)),
    Rule("notes9", ("NB9",)),
    Rule("markdown", ("txt",)),
    Rule("gifs", (), ("image/*",)),
)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents")


def _doc_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for queries that look at a few small columns only."""
    return V.table(spark, sf, "documents")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "pages").withColumnRenamed("page_id", "id")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "conversations")


def _id_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(F.col("doc_id").alias("id"), "text")


def _bytes(spark: SparkSession, sf: str) -> DataFrame:
    return _id_text(spark, sf).select("id", F.encode("text", "utf-8").alias("content"))


# -- detection -------------------------------------------------------------------------------


@query
def ext_of(spark, sf):
    return V.document_listing(_doc_keys(spark, sf)).select("id", D.ext_of(F.col("path")).alias("ext"))


@query
def kind_by_ext(spark, sf):
    kind = D.kind_of_ext(D.ext_of(F.col("path")))
    return V.document_listing(_doc_keys(spark, sf)).select("id", "path", kind.alias("kind"))


@query
def sniff_mime(spark, sf):
    return V.magic_docs(_docs(spark, sf)).select("id", D.sniff_mime(F.col("content")).alias("mime"))


@query
def mime_matches(spark, sf):
    mimes = V.magic_docs(_docs(spark, sf)).select("id", D.sniff_mime(F.col("content")).alias("mime"))
    return R.mime_pattern_hits(mimes)


def _file_rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.document_files(_docs(spark, sf), containers=False)


@query
def detect_kind(spark, sf):
    return P.with_kind(_file_rows(spark, sf), RULES).select("id", "kind")


@query
def detect_kind_strict(spark, sf):
    return P.with_kind(_file_rows(spark, sf), (), None).select("id", "kind")


@query
def kind_by_rules(spark, sf):
    rows = _file_rows(spark, sf)
    kind = D.kind_by_rules(D.ext_of(F.col("path")), F.col("content"), RULES)
    return rows.select("id", kind.alias("kind"))


@query
def kind_by_rules_table(spark, sf):
    """As many rules as documents."""
    rows = RL.with_rule_kind(_file_rows(spark, sf), V.rule_table(_docs(spark, sf)))
    return rows.select("id", "rule_kind")


@query
def registry_report(spark, sf):
    return R.registry_report(P.with_kind(_file_rows(spark, sf), RULES), RULES)


@query
def text_or_hex(spark, sf):
    return _bytes(spark, sf).select("id", D.text_or_hex(F.col("content"), 0).alias("form"))


# -- text ------------------------------------------------------------------------------------


@query
def strip_tags(spark, sf):
    return _pages(spark, sf).select("id", T.strip_tags(F.col("html")).alias("text"))


@query
def html_to_text(spark, sf):
    return _pages(spark, sf).select("id", T.html_to_text(F.col("html")).alias("text"))


@query
def truncate_chars(spark, sf):
    return _id_text(spark, sf).select("id", T.truncate_chars(F.col("text")).alias("text"))


@query
def split_pages(spark, sf):
    return L.split_pages(V.paged_docs(_docs(spark, sf)))


@query
def join_pages(spark, sf):
    return V.paged_docs(_docs(spark, sf)).select("id", T.join_pages(F.col("text")).alias("text"))


@query
def xml_text_nodes(spark, sf):
    return _pages(spark, sf).select("id", T.xml_text_nodes(F.col("html")).alias("text"))


@query
def notebook_cells(spark, sf):
    return L.notebook_cells(V.notebooks(_turns(spark, sf)))


@query
def join_slides(spark, sf):
    return L.join_slides(V.table(spark, sf, "conversations"), "turn", id_col="conv_id")


@query
def join_slides_titled(spark, sf):
    return L.join_slides(V.table(spark, sf, "conversations"), "turn", id_col="conv_id", titled=True)


@query
def printable_runs(spark, sf):
    return _bytes(spark, sf).select(
        "id",
        T.printable_runs(F.col("content")).alias("runs"),
        T.legacy_text(F.col("content")).alias("legacy"),
    )


@query
def email_fields(spark, sf):
    return L.email_rows(V.mail_messages(_turns(spark, sf)))


@query
def email_text(spark, sf):
    text = ML.email_text(ML.email_fields(F.col("raw")))
    return V.mail_messages(_turns(spark, sf)).select("id", text.alias("text"))


@query
def number_lines(spark, sf):
    return L.number_lines(_id_text(spark, sf))


@query
def sanitize(spark, sf):
    noisy = F.replace("text", F.lit(" "), F.lit(" \t\x07\r"))
    return _id_text(spark, sf).select("id", T.sanitize(noisy).alias("text"))


@query
def wrap_lines(spark, sf):
    tabbed = _id_text(spark, sf).withColumn("text", F.replace("text", F.lit(", "), F.lit(",\t")))
    return L.wrap_lines(tabbed.withColumn("text", F.concat("text", F.lit("\n"))), 40)


@query
def wrap_lines_wide(spark, sf):
    """Wide characters, marks and tabs, in rows whose width is no multiple of a tab stop."""
    return L.wrap_lines(V.wide_docs(_docs(spark, sf)), 30)


@query
def page_counts_wide(spark, sf):
    return L.page_counts(V.wide_docs(_docs(spark, sf)), 20, 30)


@query
def paginate(spark, sf):
    return L.paginate(_id_text(spark, sf)).drop("line_no", "piece_no")


@query
def page_counts(spark, sf):
    return L.page_counts(_id_text(spark, sf))


@query
def hex_dump(spark, sf):
    return L.hex_dump(_bytes(spark, sf), max_bytes=0)


@query
def json_canonical(spark, sf):
    # Every fourth value is broken, so the error column is exercised; every fifth repeats a key.
    key, props = F.col("event_id"), F.col("props")
    props = F.when(key % 5 == 1, F.concat(F.lit('{"k": [{"k": 1, "k": 2}], '), F.substr(props, F.lit(2)))).otherwise(props)
    raw = F.when(key % 4 == 3, F.concat(F.lit("{"), "props")).otherwise(props)
    return L.json_rows(V.table(spark, sf, "events").select("event_id", raw.alias("text")), "event_id")


@query
def ini_rows(spark, sf):
    return L.ini_rows(V.ini_files(_docs(spark, sf)))


@query
def ini_text(spark, sf):
    return V.ini_files(_docs(spark, sf)).select("id", T.ini_text(F.col("text")).alias("text"))


# -- markdown --------------------------------------------------------------------------------


@query
def md_lines(spark, sf):
    return MD.md_lines(V.markdown_docs(_docs(spark, sf)))


@query
def md_headings(spark, sf):
    return MD.md_headings(V.markdown_docs(_docs(spark, sf)))


@query
def md_code_blocks(spark, sf):
    return MD.md_code_blocks(V.markdown_docs(_docs(spark, sf)))


@query
def md_headings_nested(spark, sf):
    """Underlined headings and headings inside quotes."""
    return MD.md_headings(V.nested_markdown(_docs(spark, sf)))


@query
def md_code_indented(spark, sf):
    return MD.md_code_blocks(V.nested_markdown(_docs(spark, sf)))


@query
def md_tables(spark, sf):
    tables = MD.md_tables(V.markdown_docs(_docs(spark, sf)))
    return tables.select(
        "id",
        "table_no",
        "line_no",
        F.array_join("headers", "|").alias("headers"),
        F.array_join("aligns", "|").alias("aligns"),
        F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"),
        "more_rows",
    )


@query
def md_lists(spark, sf):
    return MD.md_lists(V.markdown_docs(_docs(spark, sf)))


@query
def md_reference_links(spark, sf):
    return MD.md_lists(V.linked_markdown(_docs(spark, sf))).select("id", "line_no", "text")


@query
def md_inline_text(spark, sf):
    lines = V.plain_lines(F.col("text"))
    marked = F.transform(
        lines,
        lambda l, i: F.when(i % 6 == 0, F.concat(F.lit("**"), l, F.lit("** x")))
        .when(i % 6 == 1, F.concat(F.lit("a *"), l, F.lit("* b")))
        .when(i % 6 == 2, F.concat(F.lit("`**"), l, F.lit("**` ~~c~~")))
        .when(i % 6 == 3, F.concat(F.lit("["), l, F.lit('](http://e.org "t") <https://e.org/x>')))
        .when(i % 6 == 4, F.concat(F.lit("!["), l, F.lit('](p.png "title") ![](q.png)')))
        .otherwise(F.concat(F.lit("__"), l, F.lit("__ snake_case_word \\*"))),
    )
    rows = _docs(spark, sf).select(
        F.col("doc_id").alias("id"), F.posexplode(marked).alias("line_no", "text")
    )
    return rows.select("id", "line_no", M.inline_text(F.col("text")).alias("text"))


# -- tables ----------------------------------------------------------------------------------


@query
def head_rows(spark, sf):
    lineitem = V.table(spark, sf, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
    return TB.head_rows(lineitem, order, Limits().delimited_rows)


@query
def sheet_preview(spark, sf):
    return TB.sheet_preview(V.table(spark, sf, "orders"), ["o_orderkey"])


@query
def cap_columns(spark, sf):
    return TB.cap_columns(V.table(spark, sf, "lineitem"), 5)


@query
def stringify(spark, sf):
    orders = V.table(spark, sf, "orders")
    blob = F.encode(F.col("o_orderpriority"), "utf-8")
    nullable = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    rows = orders.select("o_orderkey", "o_totalprice", nullable.alias("status"), blob.alias("blob"))
    return TB.stringify(rows, "NULL")


@query
def schema_report(spark, sf):
    return TB.schema_report({name: V.table(spark, sf, name) for name in TABLES})


@query
def pad_cells(spark, sf):
    cells = TB.pad_cells(F.split(F.col("text"), "\n", -1), 4)
    return _id_text(spark, sf).select("id", F.array_join(cells, "|").alias("cells"))


@query
def tsv_lines(spark, sf):
    rows = V.table(spark, sf, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    )
    return TB.tsv_lines(rows, ["c_custkey"])


@query
def head_per_group(spark, sf):
    orders = V.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return TB.head_per_group(orders, ["o_custkey"], ["o_orderkey"], 3)


@query
def catalog_preview(spark, sf):
    keys = {"nation": ["n_nationkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"]}
    for name in keys:
        V.table(spark, sf, name).createOrReplaceTempView(f"lens_{name}")
    preview = TB.catalog_preview(
        spark, "lens_*", order={f"lens_{name}": key for name, key in keys.items()}
    )
    return preview.withColumn("cells", F.array_join("cells", "|"))


# -- trees -----------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return V.document_listing(_doc_keys(spark, sf)).drop("id")


def _url_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return TR.build_nodes(V.url_entries(V.table(spark, sf, "pages")))


def _doc_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return TR.build_nodes(TR.drop_noise(_entries(spark, sf)))


@query
def drop_noise(spark, sf):
    return TR.drop_noise(_entries(spark, sf))


@query
def build_nodes(spark, sf):
    return _doc_nodes(spark, sf)


@query
def build_nodes_urls(spark, sf):
    return _url_nodes(spark, sf)


@query
def list_limit(spark, sf):
    return TR.list_limit(_entries(spark, sf))


@query
def preorder(spark, sf):
    return TR.preorder(_doc_nodes(spark, sf)).select("tree_id", "path", "pos")


@query
def render_tree(spark, sf):
    return TR.render_tree(_doc_nodes(spark, sf))


@query
def render_tree_urls(spark, sf):
    return TR.render_tree(_url_nodes(spark, sf), icons=True)


@query
def mode_string(spark, sf):
    n = F.col("o_orderkey")
    kind = F.when(n % 3 == 0, 0o040000).when(n % 3 == 1, 0o120000).otherwise(0o100000)
    mode = (n % 512).cast("int") + kind
    return V.table(spark, sf, "orders").select("o_orderkey", T.mode_string(mode).alias("mode"))


@query
def count_nodes(spark, sf):
    return TR.count_nodes(_doc_nodes(spark, sf))


# -- corpus ----------------------------------------------------------------------------------


@query
def preview_corpus(spark, sf):
    """Flagship: every document as a file of some kind, detected, extracted and drawn."""
    return P.preview_corpus(V.document_files(_docs(spark, sf)), UNCUT)


@query
def preview_containers(spark, sf):
    """Previews of zip-based documents, whose members are read in the same pass."""
    files = V.zipped_docs(_docs(spark, sf), "docx").select(
        F.col("path").alias("id"),
        "path",
        F.lit(False).alias("is_dir"),
        F.col("length").alias("size"),
        "content",
    )
    return P.preview_corpus(files, UNCUT)


@query
def preview_archives(spark, sf):
    return P.preview_archives(V.zipped_docs(_docs(spark, sf), "zip"), UNCUT)


@query
def preview_comics(spark, sf):
    return P.preview_comics(V.zipped_docs(_docs(spark, sf), "cbz"), UNCUT)


@query
def first_success(spark, sf):
    raw = F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    broken = T.json_canonical(F.concat(raw, F.lit("}")))
    number = F.when(F.col("event_id") % 4 != 3, F.get_json_object(raw, "$.k"))
    picked = T.first_success(raw, broken, number)
    return V.table(spark, sf, "events").select("event_id", picked.alias("p")).select("event_id", "p.*")


@query
def register_extractor(spark, sf):
    own = P.Extractors()
    own.register("markdown", lambda text, content: F.concat(F.lit("md: "), F.substring(text, 1, 20)))
    own.register("notes9", lambda text, content: F.concat(F.lit("notes: "), F.substring(text, 1, 9)), ["nb9"])
    own.register("code", lambda text, content: F.when(F.contains(text, F.lit("|")), "piped"))
    own.register("code", lambda text, content: F.when(F.contains(text, F.lit("#")), "hashed"))
    previews = P.preview_corpus(V.document_files(_docs(spark, sf)), UNCUT, own)
    return previews.select("id", "kind", "shape", "text")


# -- sources and sinks: Spark writes files from the tables, the source reads them back ---------


@query
def scan_files(spark, sf):
    path = work_dir(spark, "scan")
    _docs(spark, sf).select("lang", "text").write.partitionBy("lang").text(path)
    files = S.scan_files(spark, path, "*.txt")
    lines = F.split(F.regexp_replace(F.col("content").cast("string"), r"\n\z", ""), "\n", -1)
    return files.select(
        F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang"),
        (F.col("length") == F.octet_length("content")).alias("whole"),
        F.explode(lines).alias("line"),
    )


@query
def read_lines(spark, sf):
    """Every line with its number; a document's lines follow each other in their file."""
    path = work_dir(spark, "lines")
    numbered = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.concat_ws("\t", F.col("doc_id").cast("string"), i.cast("string"), line),
    )
    _docs(spark, sf).select(F.array_join(numbered, "\n")).write.text(path)
    files = sorted(spark.read.format("binaryFile").load(path).inputFiles())
    part = F.split("line", "\t", 3)
    lines = S.read_lines(spark, files).select(
        "line_no",
        F.get(part, F.lit(0)).cast("bigint").alias("doc_id"),
        F.get(part, F.lit(1)).cast("bigint").alias("place"),
        F.get(part, F.lit(2)).alias("line"),
    )
    first = F.min("line_no").over(W.partitionBy("doc_id"))
    return lines.select("doc_id", "place", (F.col("line_no") - first).alias("after_first"), "line")


@query
def read_delimited(spark, sf):
    path = work_dir(spark, "delimited")
    key = F.col("o_orderkey")
    line = F.concat_ws(
        ",",
        key.cast("string"),
        F.when(key % 3 != 0, F.col("o_orderstatus")),
        F.when(key % 5 == 0, F.concat(F.lit('"a,'), F.col("o_orderpriority"), F.lit('\n""b"""'))),
        F.when(key % 7 == 0, F.lit("x,,")),
    )
    V.table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    cells = S.read_delimited(spark, path, ",", header=False)
    return cells.select(
        F.get("cells", F.lit(0)).cast("bigint").alias("o_orderkey"),
        F.size("cells").alias("n_cells"),
        F.array_join("cells", "|").alias("cells"),
    )


@query
def delimited_headers(spark, sf):
    path = work_dir(spark, "headers")
    customers = V.table(spark, sf, "customer").repartition(8, "c_nationkey")
    customers.write.option("header", True).csv(path)
    body = S.read_delimited(spark, path, ",")
    names = S.delimited_headers(spark, path, ",")
    joined = body.join(names, "path")
    return joined.select(
        F.get("cells", F.lit(0)).cast("bigint").alias("c_custkey"),
        F.array_join("headers", "|").alias("headers"),
        F.get("cells", F.lit(1)).alias("c_name"),
        F.element_at("cells", -1).alias("c_mktsegment"),
    )


@query
def read_json_docs(spark, sf):
    path = work_dir(spark, "json")
    key = F.col("s_suppkey")
    doc = F.when(key % 4 == 0, F.concat(F.lit("{"), "s_name")).otherwise(
        F.to_json(F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))
    )
    suppliers = V.table(spark, sf, "supplier").select(doc.alias("value"))
    V.write_each(suppliers, path)
    docs = S.read_json_docs(spark, path)
    return docs.select(
        F.try_variant_get("value", "$.name", "string").alias("s_name"),
        F.try_variant_get("value", "$.k", "bigint").alias("s_suppkey"),
        "error",
        F.trim(F.regexp_replace("raw", r"\n\z", "")).alias("raw"),
    )


@query
def read_parquet_preview(spark, sf):
    preview = S.read_parquet_preview(
        spark, f"{sf}/orders.parquet", order=["o_orderkey"]
    )
    return preview.withColumn("cells", F.array_join("cells", "|"))


@query
def image_headers(spark, sf):
    return S.image_headers(V.image_files(_docs(spark, sf)))


@query
def archive_manifest(spark, sf):
    files = V.zipped_docs(_docs(spark, sf), "zip")
    return A.archive_manifest(files, None)


@query
def archive_tree(spark, sf):
    files = V.zipped_docs(_docs(spark, sf), "zip")
    manifest = A.archive_manifest(files, None)
    return TR.count_nodes(TR.build_nodes(A.manifest_entries(manifest)))


@query
def zip_member_text(spark, sf):
    return A.zip_member_text(V.zipped_docs(_docs(spark, sf), "docx"))


@query
def docx_paragraphs(spark, sf):
    members = A.zip_member_text(V.zipped_docs(_docs(spark, sf), "docx"))
    return members.select("path", T.docx_paragraphs(F.col("text")).alias("text"))


@query
def odt_text(spark, sf):
    members = A.zip_member_text(V.zipped_docs(_docs(spark, sf), "odt"))
    return members.select("path", T.odt_text(F.col("text")).alias("text"))


@query
def write_previews(spark, sf):
    path = work_dir(spark, "previews")
    S.write_previews(P.preview_corpus(V.document_files(_docs(spark, sf)), UNCUT), path)
    return spark.read.parquet(path)
