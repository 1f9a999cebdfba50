"""The quality classifier and the Katz model."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from math import isclose, log10
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from corpuslens.llm import common, lm_score
from corpuslens.llm.common import table
from corpuslens.llm.quality import PASSING, classify_quality, keep_quality, tree_paths


def fold(i, parts):
    return None if i is None else zlib.crc32(str(i).encode()) % parts


def test_quality_of_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = classify_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)
    assert all(r["predicted"] == (r["score"] >= PASSING) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    order = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert order > 0.95
    flipped = labels.selectExpr("doc_id", f"if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    again = {r["doc_id"]: r["score"] for r in classify_quality(docs, flipped).collect()}
    assert all(isclose(again[r["doc_id"]], r["score"], abs_tol=1e-6) for r in rows)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 14)] + [(None, 1), (99, 0), (2, None)],
                                   "doc_id bigint, quality int")
    rows = classify_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert classify_quality(none, labels).collect() == []
    one = labels.filter("quality = 1")
    assert {r["predicted"] for r in classify_quality(odd, one).collect()} == {1}
    assert {r["score"] for r in classify_quality(odd, labels.limit(0)).collect()} == {0.5}
    kept = keep_quality(odd, one)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_paths_of_a_printed_tree():
    text = """DecisionTree: depth=2
  If (feature 0 <= 0.5)
   If (feature 1 > 2.0)
    Predict: 1.0
   Else (feature 1 <= 2.0)
    Predict: 0.0
  Else (feature 0 > 0.5)
   Predict: 0.0
"""
    inf = float("inf")
    assert tree_paths(text, ["a", "b"]) == {
        (("a", -inf, 0.5),),
        (("a", -inf, 0.5), ("b", 2.0, inf)),
        (("a", -inf, 0.5), ("b", -inf, 2.0)),
        (("a", 0.5, inf),),
    }


def katz(rows):
    train = [fold(i, 7) != 2 for i, _ in rows]
    texts = [(t or "").encode().lower().split() + [0] for _, t in rows]
    words, pairs, before = Counter(), Counter(), Counter()
    for use, text in zip(train, texts, strict=True):
        if use:
            words.update(text)
            for a, w in zip([1, *text], text):
                pairs[a, w] += 1
                before[a] += 1
    n, v = sum(words.values()), len(words)

    def cuts(counts):
        times = Counter(counts)
        return lm_score.discounts([times[k] for k in range(1, 7)])

    e, d = cuts(words.values()), cuts(pairs.values())

    def one(w):
        c = words[w]
        return (e[c - 1] if c <= 5 else 1) * c / (n + 1) if c else unknown

    unknown = 1 - sum((e[c - 1] if c <= 5 else 1) * c for c in words.values()) / (n + 1)
    used, low = Counter(), Counter()
    for (a, w), r in pairs.items():
        used[a] += (d[r - 1] if r <= 5 else 1) * r / (before[a] + 1)
        low[a] += one(w)

    def two(a, w):
        r = pairs[a, w]
        if r:
            return (d[r - 1] if r <= 5 else 1) * r / (before[a] + 1)
        return (1 - used[a]) / (1 - low[a]) * one(w)

    for a in [1, *list(words)[:3], "never"]:
        assert isclose(sum(two(a, w) for w in words) + two(a, "unknown"), 1)
    return [
        (i, not use, len(t), sum(words[w] > 0 for w in t), n,
         sum(log10((words[w] + 1) / (n + v + 1)) for w in t), sum(log10(two(a, w)) for a, w in zip([1, *t], t)))
        for (i, _), use, t in zip(rows, train, texts, strict=True)
    ]


def check_katz(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    found = sorted(map(tuple, lm_score.score_documents(df).collect()), key=lambda r: (repr(r[0]), *r[2:]))
    want = sorted(katz(rows), key=lambda r: (repr(r[0]), *r[2:]))
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for mine, theirs in zip(found, want, strict=True):
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-9)


def test_katz(documents, odd, none):
    check_katz(documents)
    check_katz(odd)
    assert lm_score.score_documents(none).collect() == []


def test_katz_in_many_blocks_and_parts(documents, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(lm_score, "PART_TOKENS", 2000)
    check_katz(documents)


def test_katz_of_a_small_table(spark):
    pick = random.Random(6)
    rows = [(i, " ".join(f"w{int(pick.expovariate(0.05))}" for _ in range(9))) for i in range(30)]
    check_katz(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_block_of_a_text_of_many_words(monkeypatch):
    n = 2_200_000
    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.record_batch({"id": [1], "train": [True], "raw": [" ".join(map(str, range(n))).encode()]})
    found = [[], []]
    for out in lm_score._sorter(12, np.empty(0, "u8"))(iter([batch])):
        row = out.to_pylist()[0]
        found[0].append(np.repeat(np.frombuffer(row["word"], "u8"), np.frombuffer(row["fan"], "u4")))
        found[1].append(np.frombuffer(row["before"], "u8"))
    word, before = map(np.concatenate, found)
    keys = [lm_score.START, *(lm_score.word_key(str(i).encode()) for i in range(n)), lm_score.END]
    assert len(word) == n + 1 and dict(zip(word.tolist(), before.tolist())) == dict(zip(keys[1:], keys))
    for parts in (12, 1 << 18):
        order = lm_score.pair_order(*(np.array(x) for x in ([1, 0, 0], [n, 2, n], [5, 9, 7])), parts, n + 2)
        assert order.tolist() == [1, 2, 0]


def test_parts_get_counts_and_no_tokens(monkeypatch):
    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))

    def to_parts(copies):
        text = " ".join(f"w{i}" for i in range(20)).encode()
        batch = pa.record_batch({"id": range(copies), "train": [True] * copies, "raw": [text] * copies})
        out = [r for b in lm_score._sorter(12, np.empty(0, "u8"))(iter([batch])) for r in b.to_pylist()]
        return sum(len(r[c]) for r in out for c in ("word", "fan", "before", "trained"))

    assert to_parts(5000) == to_parts(50)


def test_numbers_in_few_bytes():
    pick = np.random.default_rng(5)
    keys = pick.integers(0, 2**64, 3000, "u8", endpoint=False)
    repeated = keys[(3000 * pick.random(20_000) ** 3).astype(int)]
    small = pick.integers(0, 300, 20_000)
    for values, most in (
        (repeated, 8 * 7_000),  # 8 * 20_000 as they are
        (keys, 8 * 3000 + 200),
        (np.sort(keys), 7 * 3000 + 200),
        (small, 2 * 20_000),
        (np.array([0, 2**64 - 1, 1], "u8"), 60),
        (np.zeros(0, "u8"), 60),
        (np.r_[7.0, 0, 3], 60),
    ):
        raw = lm_score.dense(values)
        assert lm_score.plain(raw, values.dtype.str).tolist() == values.tolist()
        assert len(raw) <= most


def test_pairs_are_written_in_few_bytes(monkeypatch):
    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    pick = random.Random(3)
    texts = [" ".join(f"w{int(pick.expovariate(0.002))}" for _ in range(200)).encode() for _ in range(500)]
    batch = pa.record_batch({"id": range(500), "train": [i % 7 != 2 for i in range(500)], "raw": texts})
    sort = lm_score._sorter(12, np.empty(0, "u8"))
    sizes = []
    for work in (sort, lm_score._dense_pairs(sort)):
        rows = [r for b in work(iter([batch])) for r in b.to_pylist()]
        sizes.append(sum(len(r[c] or b"") for r in rows for c in lm_score.NUMBERS))
    assert sizes[1] < 0.45 * sizes[0]


def test_words_frequent_in_no_block_are_split(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PART_TOKENS", 40)
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 1500)
    rows = [(i, " ".join(["often", *(f"w{i}x{k}" for k in range(1000))])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    tokens, hot = lm_score.frequent_words(df.selectExpr("doc_id id", "true train", "cast(text as binary) raw"))
    assert tokens == 30 * 1002 and hot == {b"often": 30, lm_score.END_WORD: 30}


def test_pairs_are_written_once(documents, monkeypatch):
    names = []

    def staged(df, name, by=()):
        names.append(name)
        return common.staged(df, name, by)

    monkeypatch.setattr(lm_score, "staged", staged)
    check_katz(documents)
    assert names == ["lm-sums"]


def test_words_are_counted_in_buckets_first():
    words = [f"w{i}".encode() for i in range(100_000)]
    raw = [b" ".join(words), b" ".join(words[:2] * 50), b"held out"]
    batch = pa.record_batch({"id": range(3), "train": [True, True, False], "raw": raw})
    found = [r for b in lm_score._bucket_counts(iter([batch])) for r in b.to_pylist()]
    assert found[0] == {"bucket": None, "n": 100_001 + 101 + 3} and len(found) <= lm_score.BUCKETS + 1
    assert sum(r["n"] for r in found[1:]) == 100_001 + 101
    heavy = np.array([r["bucket"] for r in found[1:] if r["n"] >= 50])
    for buckets in (heavy, heavy[:0]):
        some = [r for b in lm_score._counted(buckets)(iter([batch])) for r in b.to_pylist()]
        assert len(some) < 50 and all((r["word"] is None) == (not len(buckets)) for r in some)
        times = {r["key"] % 2**64: r["n"] for r in some}
        assert (times[lm_score.word_key(b"w0")], times[lm_score.word_key(b"w1")]) == (51, 51)


def test_short_keys_are_dealt_evenly():
    for parts in (12, 256, 4700):
        home = lm_score.mixed(np.arange(2, 100 * parts, dtype="u8")) % np.uint64(parts)
        assert 50 < np.bincount(home.astype("i8"), minlength=parts).min()


def test_common_words_have_short_keys(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    pick = random.Random(8)
    texts = [" ".join(f"w{int(pick.expovariate(0.0005))}" for _ in range(200)).encode() for _ in range(1000)]
    rows = spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "id bigint, train boolean, raw binary")
    tokens, hot, common = lm_score.counted_words(rows)
    times = Counter(w for t in texts for w in t.split())
    assert tokens == 201_000 and hot == {lm_score.END_WORD: 1000}
    assert set(common.tolist()) >= {lm_score.word_key(w) for w, n in times.items() if n > 40}
    assert lm_score.END not in common.tolist() and sorted(common.tolist()) == common.tolist()
    other = lm_score.word_key(b"other")
    keys = np.array([lm_score.START, lm_score.END, common[0], common[-1], other], "u8")
    assert lm_score.coded(keys, common).tolist() == [0, 1, 2, len(common) + 1, other]
    batch = pa.record_batch({"id": range(1000), "train": [True] * 1000, "raw": texts})
    sizes = []
    for known in (common[:0], common):
        sort = lm_score._dense_pairs(lm_score._sorter(300, np.empty(0, "u8"), known))
        sizes.append(sum(len(r["word"] + r["before"]) for b in sort(iter([batch])) for r in b.to_pylist()))
    assert sizes[1] < 0.7 * sizes[0]


def test_counts_for_another_block_are_not_taken(monkeypatch):
    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    none = np.empty(0, "u8")

    def back(texts):
        batch = pa.record_batch({"id": range(2), "train": [True, True], "raw": texts})
        sent = pa.Table.from_batches(list(lm_score._dense_pairs(lm_score._sorter(2, none))(iter([batch]))))
        out = []
        for part in range(2):
            own = sent.filter(pc.equal(sent["part"], part)).to_batches()
            table = pa.Table.from_batches(list(lm_score._part(2, none, none.astype("i8"))(iter(own))))
            out.append(table.filter(pc.equal(table["kind"], "back")))
        return out

    one, other = back([b"a b c d e f", b"a"]), back([b"a", b"a b c d e f"])
    sums = lm_score._sums(pa.concat_tables(one)).to_pylist()
    assert [r["n_tokens"] for r in sums if r["kind"] == "doc"] == [7, 2]
    with pytest.raises(ValueError, match="another order"):
        lm_score._sums(pa.concat_tables([one[0], other[1]]))


def test_katz_without_training_rows(spark):
    held = next(i for i in range(100) if fold(i, 7) == 2)
    row = lm_score.score_documents(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (True, 3, 0, 0)
    assert row["base_score"] == 0 and row["score"] == 0
