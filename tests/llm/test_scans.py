"""License scans and personal data against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

from corpuslens.llm.license_rules import BASE_RULES, RULES
from corpuslens.llm.license_scan import CONFIDENCE, scan_licenses
from corpuslens.llm.pii import BASE, find_pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def licenses(text):
    words = WORD.findall(lower(text))
    line, found = " ".join(words), []
    for r in RULES:
        if r.keyword not in line:
            continue
        for m in re.finditer(f"(?<![^ ])(?:{r.pattern})(?![^ ])", line):
            found.append((line[: m.start()].count(" "), line[: m.end()].count(" "), r))
    found.sort(key=lambda d: (d[0], -d[1], d[2].level, d[2].no))
    kept = []
    for i, (a, b, r) in enumerate(found):
        if not any(b2 >= b and q.level <= r.level for _, b2, q in found[:i]):
            kept.append((a, b, r))
    base = [d for d in found if d[2].no < BASE_RULES]
    starts = [d[0] for d in base]
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({d[2].label for d in base})),
        ",".join(sorted({d[2].label for d in base + kept})),
        max((CONFIDENCE[d[2].level] for d in kept), default=0.0),
    )


def check_licenses(df):
    rows = scan_licenses(df).drop("detections").collect()
    want = [(r["doc_id"], *licenses(r["text"])) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_licenses_of_documents(documents):
    check_licenses(documents)


def test_licenses_of_odd_rows(odd, none):
    check_licenses(odd)
    assert scan_licenses(none).collect() == []


def test_rules_overlap_and_repeat(spark):
    texts = [
        "GNU Lesser General Public License version 2.1 or later; GNU GPL",
        "cc-by-nc-sa 4.0 cc by nc CC BY NC 4.0 creative commons attribution noncommercial license",
        "Apache License, Version 2.0. apache license version 2",
        "all rights reserved. " * 900,
        "mit licence under the mit license under the  MIT\nLicense",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ]
    texts += [" ".join(r.pattern.split(" ")[:3]) for r in RULES[:50]]
    check_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def shortest(pattern):
    """A text that matches, without optional parts and with the first of alternatives."""
    text = ""
    while text != pattern:
        text, pattern = pattern, re.sub(r"\(\?:[^()]*\)\?", "", pattern)
        pattern = re.sub(r"\(\?:([^()|]*)[^()]*\)(?!\?)", r"\1", pattern)
    text = text.replace("[^ ]+", "q").replace("[0-9]{2}", "00")
    return re.sub(r".\?", "", re.sub(r"\[(.)[^]]*\]", r"\1", text))


def test_keywords_lose_no_match(spark, monkeypatch):
    texts = [shortest(p) for r in RULES for p in (r.pattern, r.pattern.replace("[cs]", "s"))]
    assert all(re.fullmatch(r.pattern, t) for r, t in zip(RULES, texts[::2], strict=True))
    monkeypatch.setitem(globals(), "RULES", [r._replace(keyword="") for r in RULES])
    check_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def luhn(number):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def personal(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    spans = [f"{BASE[k]}:{a}:{b}" for a, k, b in sorted(found)]
    counts = [sum(k == i for _, k, _ in found) for i in range(4)]
    return spans, (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def check_personal(df):
    rows = find_pii(df).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    want = sorted(((i, *personal(t)[1]) for i, t in texts), key=repr)
    assert sorted(((r["doc_id"], *[r[f"n_{k}"] for k in BASE], r["base_sha256"]) for r in rows), key=repr) == want
    spans = {r["doc_id"]: r["spans"].split(",") for r in rows}
    assert all(set(personal(t)[0]) <= set(spans[i]) for i, t in texts)


def test_personal_data_of_documents(documents, odd, none):
    check_personal(documents)
    check_personal(odd)
    assert find_pii(none).collect() == []


def test_personal_data_of_random_text(spark):
    pick = random.Random(3)
    texts = ["".join(pick.choice("ab1234567890.@+- ()é_%") for _ in range(90)) for _ in range(300)]
    texts += ["a@b.c_d@e.f x@y@z.com", "1.2.3.4.5.6.7.8 001.002.255.256", "4111 1111 1111 1111 4111-1111-1111-1112"]
    check_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_long_runs_end_soon(spark):
    texts = ["a" * 100_000, "9" * 100_000, "1." * 50_000, "x@" + "a." * 50_000, "+1" + "(" * 50_000, "+1" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in find_pii(df).collect()}
    assert rows[2]["n_ip"] == 12_500 and rows[3]["n_email"] == 1


def test_many_matches_in_one_text(spark):
    many = 300_000
    df = spark.createDataFrame([(1, "ann@b.co, " * many)], "doc_id bigint, text string")
    row = find_pii(df).collect()[0]
    assert row["n_email"] == many and len(row["found"]) == many and row["found"][-1]["start"] == 10 * (many - 1)
    df = spark.createDataFrame([(1, "under the mit license. " * many)], "doc_id bigint, text string")
    row = scan_licenses(df).collect()[0]
    assert row["n_base"] == many and row["last_word"] == 4 * (many - 1)


def test_checked_spans_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "DE88 3704 0044 0532 0130 00", "SSN 123-45-6789", "123-45-6789",
             "mail a@b.co", "zz a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in find_pii(df).collect()}
    assert [rows[i]["spans"] for i in range(4)] == ["iban:5:32", "", "ssn:4:15", ""]
    assert rows[4]["found"][0]["score"] > rows[5]["found"][0]["score"]


def iban(country, bban):
    number = "".join(str(int(c, 36)) for c in bban + country)
    return f"{country}{98 - int(number + '00') % 97:02}{bban}"


def test_ibans_end_where_their_country_says(spark):
    codes = ["BE68539007547034", "AT611904300234573201", "DE89370400440532013000", "NO9386011117947",
             "GB82WEST12345698765432", "FR1420041010050500013M02606", iban("ES", "21000418450200051332"),
             iban("MT", "MALT011000012345MTLCAST001S"), iban("SE", "50000000058398257466")]
    texts, want = [], []
    for code in codes:
        for form in (code, " ".join(code[i : i + 4] for i in range(0, len(code), 4))):
            for after in ("", ".", " BIC GEBABEBB", " Please", " A", " AB", " ABC", " ABCD EFGH", " 12", "\nPay"):
                texts.append(f"to {form}{after}")
                want.append(f"iban:3:{3 + len(form)}")
    texts += ["BE68539007547034X", "XBE68539007547034", "BE69 5390 0754 7034 BIC", "BE68 5390 0754 7034 AT61 1904 3002 3457 3201"]
    want += ["", "", "", "iban:0:19,iban:20:44"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r["spans"] for r in find_pii(df).collect()}
    assert [rows[i] for i in range(len(texts))] == want
