"""License scans with DataFrame operations only.

Ordered signature rules run over the words of a text. A text goes through three gates before a
rule's pattern is tried: plain searches for what any rule must hold, then the rule's own keyword
in its words. Detections of all rules are intervals of words; one that lies inside another of the
same or a stronger level is suppressed. Everything is a row-by-row projection without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import BLOCK, LOWER, UPPER, bound, pieces
from corpuslens.llm.license_rules import BASE_RULES, RULES, Rule

OUTSIDE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # what is no part of a word, before lower-casing
CONFIDENCE = (1.0, 0.95, 0.8, 0.5)  # of a detection by level
LEVELS = len(CONFIDENCE)
FOUND = "array<struct<start:bigint,stop:bigint,level:int,no:int,label:string,end:bigint>>"


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def words_of(text: Column) -> Column:
    """Words in lower case (A-Z only), joined by single spaces."""
    joined = F.regexp_replace(F.translate(text, UPPER, LOWER), f"[{OUTSIDE}]+", " ")
    return F.trim(joined)


def gate_word(rule: Rule) -> str:
    """A word, or its beginning, that every text a rule is tried on and matches must hold."""
    always = re.sub(r"\(\?:[^()]*\)\??", "", rule.pattern)
    if "licen" in always:
        return "licen"
    words = [w for w in always.split(" ") if w.isalnum()] + rule.keyword.split(" ")
    return max(words, key=len)


def may_match(raw: Column, rules: Sequence[Rule]) -> Column:
    """Whether a text holds the gate word of any rule: plain searches, cheap against patterns."""
    low = F.lower(raw)
    found = F.lit(False)
    for word in sorted({gate_word(r) for r in rules}):
        hit = F.contains(low, F.lit(word))
        if len(word) < 4:  # common inside words
            hit = hit & F.rlike(low, F.lit(f"(?:^|[{OUTSIDE}]){word}(?:[{OUTSIDE}]|$)"))
        found = found | hit
    return found


def detections(words: Column, rules: Sequence[Rule]) -> Column:
    """``array<struct<start, stop, level, no, label, end>>`` in words, ordered, ``stop`` = -end."""
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    table = F.array(
        *[
            F.struct(
                F.lit(r.no).alias("no"),
                F.lit(r.label).alias("label"),
                F.lit(r.level).alias("level"),
                F.lit(f" {r.keyword} " if len(r.keyword) < 4 else r.keyword).alias("keyword"),
                F.lit(f"(?<![^ ])(?:{r.pattern})(?![^ ])").alias("pattern"),
            )
            for r in rules
        ]
    )
    tried = F.filter(table, lambda r: F.contains(padded, r["keyword"]))

    def found(r: Column) -> Column:
        return F.transform(
            pieces(words, r["pattern"], spaces),
            lambda p: F.struct(
                p["start"].alias("start"),
                (-p["end"]).alias("stop"),
                r["level"].alias("level"),
                r["no"].alias("no"),
                r["label"].alias("label"),
                p["end"].alias("end"),
            ),
        )

    return F.array_sort(F.flatten(F.transform(tried, found)))


def unsuppressed(found: Column) -> Column:
    """Detections that lie in no other of the same or a stronger level, in order.

    In order of start, the longer first, a detection lies in an earlier one when that one's end is
    not before its own; the furthest end so far is kept per level, first up to every block of
    ``BLOCK`` detections and then inside, so that no growing array is copied per block.
    """
    none = F.array().cast(FOUND)

    def further(far: Column, d: Column) -> Column:
        return F.transform(
            far, lambda e, i: F.when(i == d["level"], F.greatest(e, d["end"])).otherwise(e)
        )

    def step(a: Column, d: Column) -> Column:
        inside = F.array_max(F.slice(a["far"], F.lit(1), d["level"] + 1)) >= d["end"]
        return F.struct(
            further(a["far"], d).alias("far"),
            F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(d))).alias("out"),
        )

    def by_block(blocks: Column) -> Column:
        nowhere = F.array(*[F.lit(-1).cast("bigint")] * LEVELS)
        start = F.struct(nowhere.alias("far"), F.array().cast("array<array<bigint>>").alias("before"))
        reached = F.aggregate(
            blocks,
            start,
            lambda a, xs: F.struct(
                F.aggregate(xs, a["far"], further).alias("far"),
                F.concat(a["before"], F.array(a["far"])).alias("before"),
            ),
            lambda a: a["before"],
        )
        kept = F.zip_with(
            blocks,
            reached,
            lambda xs, far: F.aggregate(
                xs, F.struct(far.alias("far"), none.alias("out")), step, lambda a: a["out"]
            ),
        )
        return F.flatten(kept)

    def cut(ordered: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.size(ordered) / F.lit(BLOCK)).cast("int"))
        return F.transform(starts, lambda b: F.slice(ordered, b * BLOCK + 1, BLOCK))

    return bound(bound(found, cut), by_block)


def scan_licenses(
    df: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = tuple(RULES)
) -> DataFrame:
    """Licenses named in every text: one row per row of ``df``.

    Returns ``(key, n_words, n_base, first_word, last_word, base_labels, labels, score,
    detections)``. The first ``BASE_RULES`` rules are counted at all their places; ``labels`` adds
    those of the other rules' detections that are not suppressed, listed in ``detections`` as word
    intervals with label and level. ``score`` is the confidence of the strongest detection, 0
    without one. Null text counts as empty: no words, no labels, null places. Repeated rows give
    repeated rows; other columns are ignored.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    gated = F.when(may_match(raw, rules), raw).otherwise("")
    n_words = F.regexp_count(raw, F.lit(f"[^{OUTSIDE}]+")).cast("bigint")
    frame = df.select(F.col(key), n_words.alias("n_words"), gated.alias("_gated"))
    frame = frame.select(key, "n_words", words_of(F.col("_gated")).alias("_words"))
    some = F.col("_words") != ""
    frame = frame.select(
        key,
        "n_words",
        F.when(some, detections(F.col("_words"), rules)).otherwise(F.array()).cast(FOUND).alias("_all"),
    )
    base = F.filter("_all", lambda d: d["no"] < BASE_RULES)
    frame = frame.select(
        "*",
        base.alias("_base"),
        F.when(F.size("_all") > 0, unsuppressed(F.col("_all"))).otherwise(F.col("_all")).alias("_kept"),
    )
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda d: d["label"])))
    labels = F.array_sort(
        F.array_union(base_labels, F.transform("_kept", lambda d: d["label"]))
    )
    confidence = F.array(*map(F.lit, CONFIDENCE))
    best = F.array_max(F.transform("_kept", lambda d: F.get(confidence, d["level"])))
    return frame.select(
        key,
        "n_words",
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("_base", lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda d: d["start"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
        F.transform(
            "_kept",
            lambda d: F.struct(
                d["start"].alias("start"),
                (d["end"] + 1).alias("end"),
                d["label"].alias("label"),
                d["level"].alias("level"),
            ),
        ).alias("detections"),
    )
