"""Reports over a corpus and the kind registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.detect import custom_rules, mime_matches
from corpuslens.registry import KINDS, Rule, registry_frame


def registry_report(corpus: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """``(kind, priority, extensions, n_patterns, n_rules, n_files, in_use)``, custom kinds last.

    The corpus (a frame with a ``kind`` column) is counted per kind before it meets the registry.
    """
    spark = corpus.sparkSession
    report = registry_frame(spark)
    customs = custom_rules(rules)
    if customs:
        rows = F.array(
            *[
                F.struct(
                    F.lit(r.name).alias("kind"),
                    F.lit(len(KINDS) + i).alias("priority"),
                    F.array(*[F.lit(e) for e in r.extensions]).cast("array<string>").alias("extensions"),
                    F.array(*[F.lit(m) for m in r.mime]).cast("array<string>").alias("mime"),
                )
                for i, r in enumerate(customs, start=1)
            ]
        )
        report = report.unionByName(spark.range(1).select(F.inline(rows)))
    per_rule: dict[str, int] = {}
    for rule in rules:
        per_rule[rule.name] = per_rule.get(rule.name, 0) + 1
    n_rules = F.lit(0)
    for name, n in per_rule.items():
        n_rules = F.when(F.col("kind") == name, n).otherwise(n_rules)
    counts = corpus.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"))
    return report.join(counts, "kind", "left").select(
        "kind",
        "priority",
        F.array_join("extensions", ", ").alias("extensions"),
        F.size("mime").alias("n_patterns"),
        n_rules.alias("n_rules"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.col("n_files").isNotNull().alias("in_use"),
    )


def mime_pattern_hits(df: DataFrame, id_col: str = "id", mime_col: str = "mime") -> DataFrame:
    """``(id, mime, kind, pattern)``: every registry pattern a MIME type matches.

    The patterns are a fixed literal array that is filtered inside the row.
    """
    patterns = F.array(
        *[
            F.struct(F.lit(k.name).alias("kind"), F.lit(m).alias("pattern"))
            for k in KINDS
            for m in k.mime
        ]
    )
    hits = F.filter(patterns, lambda p: mime_matches(p["pattern"], F.col(mime_col)))
    return df.select(id_col, mime_col, F.inline(hits))
