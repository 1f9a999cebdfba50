"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from functools import cache

from corpuslens.llm import conversation_repair as repair
from corpuslens.llm.conversation_repair import Row, digests, repair_conversations, repaired_rows, search, written
from corpuslens.llm.queries import op12_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, extra string, same int, audit string, part int"
sys.setrecursionlimit(10_000)
SHAPE = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows, kinds):
    """Of all sequences of edits the cheapest, then least, with the rows it leaves."""

    @cache
    def best(i, last):
        # last: initial of the last row that stays, "" before any
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        # more than two insertions in a row only add a pair that can be left out
        for n in (1, 2) if i < len(rows) else (1,):
            if i == len(rows) and last not in ("s", "u"):
                break
            to, added = last, []
            for _ in range(n):
                to = "a" if to == "u" else "u"
                added.append({"u": "user:", "a": "assistant:"}[to])
            for cost, edits, left in rest(i, to, n < 3):
                found.append((3 * n + cost, "I" * n + edits, (*added, *left)))
        found += rest(i, last, False)
        return min(found)

    def rest(i, last, inserted):
        if i == len(rows):
            return [best(i, last)] if inserted else []
        role, text = rows[i]
        out = []
        cost, edits, left = best(i + 1, last)
        out.append((4 + cost, "D" + edits, left))
        if kinds[i] not in ("blank", "duplicate"):
            stays, first = 3 * (kinds[i] == "truncated"), role[:1]
            if (last, first) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                cost, edits, left = best(i + 1, first)
                out.append((stays + cost, "K" + edits, (f"{role}:{text}", *left)))
            due = "a" if last == "u" else "u"
            cost, edits, left = best(i + 1, due)
            out.append((3 + stays + cost, "R" + edits, ({"u": "user", "a": "assistant"}[due] + f":{text}", *left)))
        return out

    return best(0, "")


def repaired(rows):
    """The registered query's columns for the rows ``(turn, role, text)`` of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], same(*r[1:])))
    kinds = faults([r[1:] for r in rows])
    cost, audit, left = cheapest([r[1:] for r in rows], kinds)
    initials = "".join(x[:1] for x in left)
    assert SHAPE.fullmatch(initials)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(left).encode()).hexdigest()
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def same(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def damaged(rows):
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else x
        fold = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if fold == 1 else re.sub("[.!?]", "", text) if fold == 2 else text
        if fold:
            yield from [(conv, turn, "user" if fold == 4 else role, text)] * (1 + (fold == 3))


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return {c: repaired(r) for c, r in out.items()}


def check(df, **how):
    rows = [tuple(" " if c in ("role", "text") and r[c] is None else r[c] for c in ("conv_id", "turn", "role", "text"))
            for r in df.collect()]
    report = repair_conversations(df, **how)
    hashes = {r["conv_id"]: r["sha256"] for r in digests(repaired_rows(df, report)).collect()}
    empty = hashlib.sha256().hexdigest()
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    got = {r["conv_id"]: (*(r[c] for c in columns), hashes.get(r["conv_id"], empty)) for r in report.collect()}
    assert got == by_conversation(rows)


def random_rows(pick, conv, n, turns=None):
    roles = ["user", "assistant", "system", "u", "tool", "", None, "Arthur"]
    weights = [8, 8, 2, 1, 1, 1, 1, 1]
    texts = ["Yes.", "no", "é!", "why?\n ", "", " \t\x0b", None, "a "] + [f"text {i}." for i in range(30)]
    turn = lambda i: pick.choice([i, i, i, i + 2, None]) if turns is None else pick.choice(turns)
    return [(conv, turn(i), *pick.choices(roles, weights), pick.choice(texts), "x", 1, "x", 2) for i in range(n)]


def test_repair_of_random_conversations(spark):
    pick = random.Random(12)
    rows = [r for conv in range(150) for r in random_rows(pick, conv, pick.randrange(1, 9))]
    rows += random_rows(pick, None, 6) + random_rows(pick, -5, 9, [None]) + random_rows(pick, -6, 9, [3])
    rows += [(-7, 1, "user", "same.", "x", 1, "x", 2)] * 50 + random_rows(pick, -8, 90)
    df = spark.createDataFrame(rows, SCHEMA)
    check(df)
    check(df.repartition(5), segment=3)


def test_repair_of_one_long_conversation(spark):
    pick = random.Random(5)
    df = spark.createDataFrame(random_rows(pick, 1, 400) + random_rows(pick, 2, 3), SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(df, segment=20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_search_bounds_rise(monkeypatch):
    pick = random.Random(8)
    for block in (1, 3, 32):
        monkeypatch.setattr(repair, "BLOCK", block)
        for _ in range(60):
            rows = [Row(pick.choice("suua?a"), pick.random() < 0.2, pick.random() < 0.3) for _ in range(pick.randrange(14))]
            shown = [({"s": "s", "u": "u", "a": "a", "?": "x"}[r.initial], "t") for r in rows]
            kinds = ["blank" if r.must_go else "truncated" if r.truncated else "" for r in rows]
            cost, edits = search(rows)
            assert (cost, edits) == cheapest(shown, kinds)[:2]
    assert search([Row("u", True, False, 3)]) == (16, "D") and written("D", [Row("u", True, False, 3)]) == "DDDD"
    assert search([Row("a", False, False)] * 50, 1, 0) is None


def test_registered_query(spark, tmp_path):
    pick = random.Random(2)
    rows = [r for conv in range(200) for r in random_rows(pick, conv, pick.randrange(1, 5))] + random_rows(pick, None, 4)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = dict.fromkeys({r[0] for r in rows}, (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))
    want |= by_conversation(damaged(r[:4] for r in rows))
    assert got == want and any(not w[6] for w in want.values())


def test_no_conversations(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(none).collect() == []
    none.write.parquet(f"{tmp_path}/conversations.parquet")
    assert op12_conversation_repair(spark, str(tmp_path)).collect() == []
