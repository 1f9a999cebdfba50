"""Ranked search against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm import ranked_search
from corpuslens.llm.common import table
from corpuslens.llm.ranked_search import nra, search_ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top=10):
    docs = [(k, Counter(terms(t))) for k, t in docs]
    docs = [(k, c, sum(c.values())) for k, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for k, c, n in docs:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(
                q * math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, q in Counter(terms(text)).items() if c[t]
            )
            found.append((-score, k is None, k or 0, k))
        best = sorted(f for f in found if f[0] < 0)[:top]
        out += [(item, r, k, -s) for r, (s, _, _, k) in enumerate(best, 1)]
    return sorted(out, key=repr)


def check(docs, items, **how):
    got = [tuple(r) for r in search_ranked(docs, items, **how).collect()]
    pairs = [[(r[0], r[1]) for r in df.select(k, "text").collect()] for df, k in ((docs, "doc_id"), (items, "item_id"))]
    assert sorted(got, key=repr) == ranked(*pairs, how.get("top", 10))


def test_ranks_of_documents(spark, documents, monkeypatch):
    items = table(spark, "/root/testdata/sf0.001", "benchmark")
    check(documents, items)
    monkeypatch.setattr(ranked_search, "DEPTH", 1)
    check(documents.repartition(3), items, postings=500, block_terms=300, top=3)


def test_ranks_of_odd_rows(odd, none, spark):
    texts = ["w1 w2 W2 mit License", None, "", "é😀", "never said", "a B.c the mit the license w59"]
    items = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "w3")], "item_id bigint, text string")
    items = items.withColumn("terms", F.lit("x")).withColumn("q", F.lit(1))
    check(odd, items)
    check(odd, items, top=2, postings=1)
    assert search_ranked(none, items).collect() == []
    assert search_ranked(odd, items.limit(0)).collect() == []
    assert search_ranked(odd, items.filter("text = ''")).collect() == []


def test_ties_and_random_texts(spark):
    pick = random.Random(11)
    words = ["a", "b", "c", "d", "e", "F", "ü", "7"]
    docs = [(i // 2, " ".join(pick.choice(words) for _ in range(pick.randrange(6)))) for i in range(400)]
    items = [(i, " ".join(pick.choice(words) for _ in range(pick.randrange(7)))) for i in range(12)]
    for postings in (50, 1 << 20):
        check(spark.createDataFrame(docs, "doc_id bigint, text string"),
              spark.createDataFrame(items, "item_id bigint, text string"), postings=postings)


def test_reading_stops_before_the_ends(monkeypatch):
    monkeypatch.setattr(ranked_search, "DEPTH", 4)

    class Reads(np.ndarray):
        far = 0

        def __getitem__(self, at):
            if isinstance(at, slice) and at.stop:
                Reads.far = max(Reads.far, at.stop)
            return np.ndarray.__getitem__(self, at)

    n, rng = 5000, np.random.default_rng(1)
    lists = []
    for _ in range(3):
        places = np.concatenate([np.arange(5), rng.permutation(np.arange(5, n))])
        lists.append((places.view(Reads), np.concatenate([np.full(5, 10**6), np.full(n - 5, 10)])))
    places, scores = nra(lists, n, 5)
    assert list(places) == [0, 1, 2, 3, 4] and set(scores.tolist()) == {3 * 10**6}
    assert Reads.far < n // 10
