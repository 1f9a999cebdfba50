"""Quality classifier as a sparse rule ensemble.

Statistics of a text are Spark columns. Trees are grown over them on labelled rows; the path to
every node of every tree is a rule, a conjunction of thresholds. A lasso logistic regression over
the rules keeps few of them, and these compile into one Spark column, so that scoring is a
projection. Trees and regression are Spark's own, fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from functools import reduce
from math import log
from operator import and_
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import SPACE, crc32_fold, staged

FOLDS = 5  # fold 0 is held out
SAMPLE_ROWS = 100_000  # labelled rows used for fitting, chosen by the hash of their key
TREES, DEPTH, LASSO = 24, 4, 0.0005
PASSING = 0.3  # least score that predicts label 1

PLAIN = r"[a-zß-öø-ÿ \n]+"  # what most of an ordinary text is made of
MARKS = {
    "upper": "A-ZÀ-ÖØ-Þ",
    "digit": "0-9",
    "stop": r".,;:?'\"()\-",
    "bang": "!",
    "pipe": "|",
    "sign": r"*#$%&@^~=+<>{}\[\]/\\_",
}


class Rule(NamedTuple):
    weight: float
    bounds: tuple[tuple[str, float, float], ...]  # statistic, above, at most

    def holds(self) -> Column:
        parts = []
        for name, low, high in self.bounds:
            parts += [F.col(name) > low] * (low > float("-inf")) + [F.col(name) <= high] * (high < float("inf"))
        return reduce(and_, parts)


class Model(NamedTuple):
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Probability of label 1 over the columns of :func:`statistics`."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.holds(), rule.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the statistics of its whole texts added; null counts as empty."""
    raw = F.coalesce(F.col(text), F.lit(""))
    base = df.select(
        "*",
        F.length(raw).cast("double").alias("st_chars"),
        F.regexp_replace(raw, PLAIN, "").alias("_rest"),
        F.filter(F.split(raw, f"[{SPACE}]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split(raw, "\n"), lambda x: x != "").alias("_lines"),
    )
    words, lines = F.col("_words"), F.col("_lines")

    def share(n: Column, of: Column) -> Column:
        return (n / F.greatest(of, F.lit(1))).cast("double")

    def count(marks: str) -> Column:
        return F.length(F.regexp_replace("_rest", f"[^{marks}]+", ""))

    again = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b)
    repeats = F.size(F.filter(again, lambda same: same))
    ended = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(r"[.!?]\s*\z"))))
    short = F.size(F.filter(words, lambda w: F.length(w) <= 3))
    stats = {
        "st_words": F.size(words).cast("double"),
        "st_word_length": share(F.col("st_chars"), F.size(words)),
        "st_short_words": share(short, F.size(words)),
        "st_distinct": share(F.size(F.array_distinct(words)), F.size(words)),
        "st_repeats": share(repeats, F.size(words)),
        "st_lines": F.size(lines).cast("double"),
        "st_distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "st_ended_lines": share(ended, F.size(lines)),
        "st_line_length": share(F.col("st_chars"), F.size(lines)),
    } | {f"st_{name}": share(count(marks), F.col("st_chars")) for name, marks in MARKS.items()}
    return base.select("*", *[c.alias(n) for n, c in stats.items()]).drop("_rest", "_words", "_lines")


STAT_NAMES = [
    *("st_chars", "st_words", "st_word_length", "st_short_words", "st_distinct", "st_repeats"),
    *("st_lines", "st_distinct_lines", "st_ended_lines", "st_line_length"),
    *[f"st_{name}" for name in MARKS],
]


def tree_paths(text: str, names: list[str]) -> set[tuple[tuple[str, float, float], ...]]:
    """The path to every node of a tree, from its printed form, as bounds per statistic."""
    found, path = set(), []
    for line in text.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1]) - 2
            path = [*path[:depth], (names[int(m[2])], m[3], float(m[4]))]
            bounds: dict[str, tuple[float, float]] = {}
            for name, sign, at in path:
                low, high = bounds.get(name, (float("-inf"), float("inf")))
                bounds[name] = (max(low, at), high) if sign == ">" else (low, min(high, at))
            found.add(tuple((n, *b) for n, b in sorted(bounds.items())))
    return found


def fit_rules(train: DataFrame, label: str) -> Model:
    """Grow trees over the statistics, take their paths as rules, keep what the lasso keeps.

    Without rows of both labels the score is the share of label 1, each label counted once more.
    """
    n, ones = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
    if not 0 < ones < n:
        odds = (ones + 1) / (n - ones + 1)
        return Model(log(odds), ())
    vectors = VectorAssembler(inputCols=STAT_NAMES, outputCol="stats").transform(train)
    forest = RandomForestClassifier(
        featuresCol="stats",
        labelCol=label,
        numTrees=TREES,
        maxDepth=DEPTH,
        minInstancesPerNode=max(2, min(20, n // 200)),
        featureSubsetStrategy="onethird",
        maxBins=64,
        seed=7,
    ).fit(vectors)
    paths = sorted(set().union(*(tree_paths(t.toDebugString, STAT_NAMES) for t in forest.trees)))
    if not paths:
        return Model(log(ones / (n - ones)), ())
    rules = [Rule(0.0, p) for p in paths]
    flags = F.transform(F.array(*[r.holds() for r in rules]), lambda b: b.cast("double"))
    table = staged(train.select(F.col(label).cast("double").alias("label"), flags.alias("flags")), "quality-rules")
    lasso = LogisticRegression(
        featuresCol="rules", elasticNetParam=1.0, regParam=LASSO, maxIter=80, tol=1e-5
    ).fit(table.select("label", array_to_vector("flags").alias("rules")))
    kept = [Rule(float(w), r.bounds) for w, r in zip(lasso.coefficients.toArray(), rules, strict=True) if w]
    return Model(float(lasso.intercept), tuple(kept))


def train_quality(
    stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = SAMPLE_ROWS
) -> Model:
    """Fit on labelled rows outside the held-out fold; of more than ``rows`` the hash of the key
    chooses about that many."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter(
        "_key is not null and _label is not null"
    )
    known = known.filter(crc32_fold(F.col("_key"), FOLDS) != 0)
    total = known.count()
    if total > rows:
        bits = 1 << 30
        known = known.filter(F.pmod(F.xxhash64("_key"), F.lit(bits)) < int(bits * rows / total))
    train = stats.join(known, stats[key] == known["_key"]).select("_label", *STAT_NAMES)
    return fit_rules(staged(train, "quality-train"), "_label")


def classify_quality(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """``(key, held_out, score, predicted)``, one row per row of ``df``.

    ``score`` estimates the probability of label 1 from statistics of the whole text alone;
    ``predicted`` is 1 from ``PASSING`` up. Rows whose ``crc32(key as text) mod 5`` is 0 are held
    out and teach nothing. Null text counts as empty and is scored as such; rows with a null key
    teach nothing and are not held out; labels without a row and repeated rows are fine; an empty
    table gives no rows; other columns are ignored.
    """
    stats = statistics(df.select(F.col(key), F.col(text).alias("_text")), "_text").drop("_text")
    stats = staged(stats, "quality-stats")
    model = train_quality(stats, labels, key, label)
    score = model.score()
    return stats.select(
        key,
        F.coalesce(crc32_fold(F.col(key), FOLDS) == 0, F.lit(False)).alias("held_out"),
        score.alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= PASSING, 1).otherwise(0))


def keep_quality(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """The rows of ``df`` that are predicted to have label 1, as they are."""
    plain = df.select(F.col(key), F.col(text).alias("_text"))
    stats = staged(statistics(plain, "_text").drop("_text"), "quality-stats")
    model = train_quality(stats, labels, key, label)
    whole = df.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return statistics(whole, "_text").filter(model.score() >= PASSING).select("_row.*")
