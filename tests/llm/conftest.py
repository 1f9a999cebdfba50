from __future__ import annotations

import random
from pathlib import Path

import pytest

from corpuslens.llm.common import table

DATA = Path("/root/testdata/sf0.001")
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, key string, n int, "
    "size string, raw string, place int, rid int, src string, _text string, st_chars string, h int, node int"
)


def odd_rows() -> list[tuple]:
    """Documents with nulls, empty and very long texts, ties, repeats; columns with clashing names."""
    pick = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    long = " ".join(pick.choice(words) for _ in range(30_000))
    base = [pick.choice(words) for _ in range(40)]
    texts = {
        1: "Under the MIT License. Call +1 555 123 4567",
        2: "UNDER THE MIT LICENSE. call +1 555 123 4567",
        3: None,
        4: "",
        5: " \n\t ",
        6: long,
        7: " ".join(base),
        8: " ".join(base[:-1] + ["else"]),
        9: " ".join(["start", *base]),
        10: "é😀 ÉÀ a@b.co " * 3,
        11: "a",
        12: "A",
        13: " ".join(base[:20]),
    }
    rows = [(i, t, None, pick.choice(["s1", "s2", "é", None]), None) for i, t in texts.items()]
    rows += [rows[0], rows[0], (None, "no key at all", None, "s1", 3), (None, None, None, None, None)]
    return [(*r, 7, "x", 1, "x", "x", 2, 3, "x", "x", "x", 4, 5) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    if not DATA.is_dir():
        pytest.skip("no tables")
    return table(spark, str(DATA), "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, str(DATA), "labels")
