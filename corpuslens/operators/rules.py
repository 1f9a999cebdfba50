"""Kinds by user rules that are a table: any number of them, without a plan that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import detect as D
from corpuslens.registry import KIND_NAMES

TEXT_MIMES = ("text/html", "text/xml", "application/x-ole-storage")


def known_mimes() -> list[str]:
    """Every MIME type that :func:`corpuslens.functions.detect.sniff_mime` can give."""
    return sorted({m for _, _, m in D.MAGIC} | {m for _, m in D.OLE_CLASSES} | set(TEXT_MIMES))


def _first_by(rules: DataFrame, key: str) -> DataFrame:
    return rules.groupBy(key).agg(F.min("name").alias("name"))


def mime_owners(rules: DataFrame) -> DataFrame:
    """``(mime, name)``: the first rule by name that claims each MIME type the detection knows.

    A pattern ending in ``/`` or holding ``*`` is a prefix. Every prefix of a known type meets the
    patterns by equality, so the join's result is bounded by the known types, not by the rules.
    """
    pattern = F.col("pattern")
    is_prefix = F.endswith(pattern, F.lit("/")) | F.contains(pattern, F.lit("*"))
    patterns = rules.select("name", F.explode("mime").alias("pattern")).select(
        "name",
        F.when(is_prefix, F.regexp_replace(pattern, r"\*+\z", "")).otherwise(pattern).alias("key"),
        is_prefix.alias("prefix"),
    )
    patterns = patterns.groupBy("key", "prefix").agg(F.min("name").alias("name"))
    types = rules.sparkSession.createDataFrame([(m,) for m in known_mimes()], "mime string")
    prefixes = types.select(
        "mime", F.explode(F.sequence(F.lit(0), F.length("mime"))).alias("n")
    ).select("mime", F.expr("left(mime, n)").alias("key"), F.lit(True).alias("prefix"))
    exact = types.select("mime", F.col("mime").alias("key"), F.lit(False).alias("prefix"))
    return _first_by(prefixes.unionByName(exact).join(patterns, ["key", "prefix"]), "mime")


def with_rule_kind(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (with ``path`` and binary ``content``) and ``rule_kind``: the first rule by name that claims
    the extension or the MIME type of the leading bytes, null where none does.

    ``rules`` has ``name``, ``extensions`` and ``mime`` (arrays of text, null for none). Names of built-in
    kinds are left out, as are null names. Rules meet files by equality on two small columns; the
    planner broadcasts them only behind its own size check.
    """
    own = rules.filter(F.col("name").isNotNull() & ~F.col("name").isin(*KIND_NAMES))
    extensions = own.select("name", F.explode("extensions").alias("_ext"))
    extensions = extensions.withColumn("_ext", F.lower("_ext"))
    by_ext = _first_by(extensions, "_ext").withColumnRenamed("name", "_by_ext")
    by_mime = mime_owners(own).select(F.col("mime").alias("_mime"), F.col("name").alias("_by_mime"))
    seen = files.withColumns({"_ext": D.ext_of(F.col("path")), "_mime": D.sniff_mime(F.col("content"))})
    joined = seen.join(by_ext, "_ext", "left").join(by_mime, "_mime", "left")
    return joined.select(*files.columns, F.least("_by_ext", "_by_mime").alias("rule_kind"))
