"""The pipeline, stage by stage, on the rows its predecessor kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
from corpuslens.llm.common import staged
from tests.llm.conftest import DATA
from tests.llm.test_dedup import exact, linked


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_decide_on_what_they_get(spark, documents):
    assert [name for name, _ in pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights",
        "best-fit packing"]
    before, rows = pairs(documents), {0: documents}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        rows[k + 1] = staged(stage(spark, rows[k], str(DATA)), f"test-{k}")
        if k < 4:
            assert rows[k + 1].columns == documents.columns
        after = pairs(rows[k + 1]) if k < 4 else None
        if name == "exact dedup":
            keep = {r[0] for r in exact(before) if r[3]}
            assert Counter(after) == Counter(p for p in before if p[0] in keep)
        elif name == "n-gram Jaccard join":
            found = linked(before)
            assert Counter(after) == Counter(p for p in before if found[p[0]][1] == p[0])
        elif name.startswith("mixing"):
            assert set(after) <= set(before) and max(Counter(after).values()) <= 2
        elif k == 4:
            assert {r["doc_id"] for r in rows[5].collect()} == {i for i, _ in before}
        before = after
    again = pipeline.run(spark, str(DATA))
    assert again.columns == rows[5].columns and again.count() == rows[5].count()


def test_stages_on_odd_rows(spark, odd, none):
    for _, stage in pipeline.STAGES[:4]:
        found = stage(spark, odd, str(DATA))
        assert found.columns == odd.columns
        assert set(pairs(found)) <= set(pairs(odd))
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, str(DATA)).collect() == []


def test_near_copies_share_four_fifths_of_five_word_shingles(spark, documents):
    base = [f"w{i}" for i in range(200)]
    texts = [base, base + [f"x{i}" for i in range(40)], base + [f"y{i}" for i in range(60)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for df in (spark.createDataFrame(rows, "doc_id bigint, text string"), documents):
        before = pairs(df)
        found = linked(before, 80, 5)
        after = pairs(pipeline.near_dedup(spark, df, str(DATA)))
        assert Counter(after) == Counter(p for p in before if found[p[0]][1] == p[0])
    assert {i for i, (_, c) in linked(rows, 80, 5).items() if c == i} == {0, 2}
