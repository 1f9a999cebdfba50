"""Compression rules against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import zstandard

from corpuslens.llm import compression_rules
from corpuslens.llm.compression_rules import BANDS, CHUNK, in_repeats, judge_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def judged(text):
    text = text or ""
    words, data = WORD.findall(text), text.encode()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup_lines = set(), 0
    for line in text.split("\n"):
        dup_lines += bool(WORD.search(line)) and line in seen
        seen.add(line)
    squeeze = zstandard.ZstdCompressor(level=3)

    def good(part):
        band = [b for b in BANDS if b.size <= len(part)][-1]
        return band.low <= len(squeeze.compress(part)) / len(part) <= band.high

    parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)] if len(data) > CHUNK else []
    bad = sum(not good(p) for p in parts)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    kept = not failed and good(data) and 4 * bad <= len(parts)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, dup_lines, len(repeated), len(parts), bad, failed, kept)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chunks", "n_bad_chunks",
           "base_failed", "kept"]


def check(df):
    rows = judge_texts(df).collect()
    want = [(r["doc_id"], *judged(r["text"])) for r in df.select("doc_id", "text").collect()]
    assert sorted([(r["doc_id"], *[r[c] for c in COLUMNS]) for r in rows], key=repr) == sorted(want, key=repr)


def test_rules_of_documents(documents, odd, none):
    check(documents)
    check(odd)
    assert judge_texts(none).collect() == []


def test_rules_of_random_texts(spark, monkeypatch):
    pick = random.Random(13)
    texts = []
    for n in (0, 7, 8, 9, 20, 40, 300, 2000):
        for kinds in (1, 2, 3, 40):
            texts.append("".join(pick.choice(["a", "b", "é😀", "#x"][:kinds] if kinds < 9 else [f"w{i}" for i in range(kinds)])
                                 + pick.choice([" ", "\n", "\t\x0b", " \n\n "]) for _ in range(n)))
    texts += ["a b c\x85d \x1c\x1f e", "x" * 300_000, "".join(chr(pick.randrange(33, 0x2FF)) for _ in range(9000))]
    texts += [" ".join(str(pick.random()) for _ in range(3000)) + " the same words over and over again" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    check(df)
    monkeypatch.setattr(compression_rules, "SLICE", 100)
    check(df)


def test_windows_whose_hashes_meet(monkeypatch):
    words, owner = np.array([1, 2] * 20 + [3] * 12 + [1, 2] * 20), np.array([0] * 45 + [1] * 47)
    want = in_repeats(words, owner)
    sort = np.argsort

    def collide(values, **kwargs):
        values[:] = 7
        return sort(values, **kwargs)

    monkeypatch.setattr(compression_rules.np, "argsort", collide)
    assert (in_repeats(words, owner) == want).all() and want.any() and not want.all()


def test_repetition_and_noise_go_and_prose_stays(spark):
    pick = random.Random(3)
    words = ["".join(pick.choice("etaoinshrdlu") for _ in range(pick.randrange(2, 9))) for _ in range(4000)]
    prose = {n: " ".join(pick.choice(words) for _ in range(n)) for n in (30, 300, 3000, 30_000)}
    noise = {n: " ".join("".join(chr(pick.randrange(0x100, 0x4000)) for _ in range(12)) for _ in range(n)) for n in (300, 3000)}
    near = {n: " ".join(f"line {i} of many that are all alike" for i in range(n)) for n in (300, 3000)}
    texts = [*prose.values(), *noise.values(), *near.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r["doc_id"]: r["kept"] for r in judge_texts(df).collect()}
    assert [kept[i] for i in range(len(texts))] == [True] * 4 + [False] * 4


def test_rules_need_no_shuffle(documents):
    plan = judge_texts(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
