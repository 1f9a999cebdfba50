"""Packing, mixing, sharding and nearest neighbours."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import groupby
from math import ceil

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import hnsw
from corpuslens.llm.ann import nearest
from corpuslens.llm.mixing import mix_documents, mix_schedule
from corpuslens.llm.packing import pack_documents, plan_packing
from corpuslens.llm.sharding import lpt, shard_documents

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def check_packing(df, capacity):
    rows = pack_documents(df, VOCABULARY, capacity, with_ids=True).collect()
    tokens = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = [*tokens.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            crc = zlib.crc32(np.array(part, "<u4").tobytes())
            want[r["doc_id"], k // capacity, k, len(part), crc, tuple(part)] += 1
    assert Counter((*tuple(r)[:5], tuple(r["ids"])) for r in rows) == want
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    return len(at), ceil(sum(r["length"] for r in rows) / capacity)


def test_packing(spark, documents, odd, none):
    used, least = check_packing(documents, 2048)
    assert used <= least + 2
    check_packing(odd, 64)
    assert pack_documents(none, VOCABULARY).collect() == []


def test_tokens_of_odd_texts(spark):
    texts = ["don't stop'll I'M", "a\x1cb\x1d", "ﬁ Ⅷ ½² x", "<|endoftext|> a<|startoftext|>b", "İstanbul Σας", "中文 字",
             "é é", "###'s ''' 're", "a b c", "1234 5.6", "x" * 3000]
    check_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 50)


def sequences(plan):
    out = defaultdict(list)
    for length, first, last, sequence, each, offset in plan.runs:
        for k in range(last - first):
            out[sequence + k // each].append((offset + k % each * length, length))
    return out


def fewest(lengths, capacity):
    """Smallest number of sequences by exhaustive search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[i]}:
            go(i + 1, [*[r for k, r in enumerate(rooms) if k != rooms.index(room)], room - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_plans_are_whole_and_short():
    pick = random.Random(8)
    over = 0
    for _ in range(150):
        capacity = pick.choice([10, 20, 50])
        lengths = [pick.randint(1, capacity) for _ in range(pick.randint(0, 9))]
        plan = plan_packing(Counter(lengths), capacity)
        found = sequences(plan)
        assert Counter(n for parts in found.values() for _, n in parts) == Counter(lengths)
        assert len(found) == plan.sequences
        for parts in found.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            assert sum(n for _, n in parts) <= capacity
        over += plan.sequences - fewest(lengths, capacity)
    assert over <= 2


def test_reduction_keeps_the_fewest():
    pick = random.Random(9)
    for _ in range(150):
        lengths = [pick.randint(1, 20) for _ in range(pick.randint(1, 8))]
        plan = plan_packing({}, 20)
        plan.left = [0] * 21
        for n in lengths:
            plan.left[n] += 1
        plan.reduce()
        rest = [n for n, k in enumerate(plan.left) for _ in range(k)]
        assert plan.fixed + fewest(rest, 20) == fewest(lengths, 20)


def targets(sizes, weights, share, repeats):
    """Shares by handing the excess on until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > repeats * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in free}
        full |= {s: repeats * sizes[s] for s in over}
        left = share * sum(sizes.values()) - sum(full.values())
        if len(full) == len(order):
            return full


def check_mix(df, **options):
    rows = mix_documents(df, **options).collect()
    texts = df.select("doc_id", "text", "source").collect()
    size = [len((r["text"] or "").encode().split()) for r in texts]
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter(
        (r["doc_id"], n) for r, n in zip(texts, size, strict=True)
    )
    of = Counter()
    for r, n in zip(texts, size, strict=True):
        of[r["source"]] += n
    want = targets(of, (5, 2, 1), 1.5, 2)
    taken, source = Counter(), {(r["doc_id"], n): r["source"] for r, n in zip(texts, size, strict=True)}
    for r in rows:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == of[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert sorted(map(tuple, mix_documents(df.repartition(3), **options).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_mix(documents, odd, none):
    check_mix(documents)
    check_mix(documents, block=50)
    check_mix(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    assert mix_documents(odd).count() == odd.count()
    assert mix_documents(none).collect() == []


def test_schedule_spreads_sources(spark):
    rows = spark.range(400).selectExpr("id as rid", "concat('0', id % 3) as src", "10L as size", "md5(string(id)) as h")
    plan = spark.createDataFrame([("00", 1340, 5, 2000.0), ("01", 1330, 2, 800.0), ("02", 1330, 1, 400.0)],
                                 "src string, source_size bigint, weight int, target double")
    slots = mix_schedule(rows, plan, 10).orderBy("slot").collect()
    assert Counter(r["src"] for r in slots) == {"00": 200, "01": 80, "02": 40}
    for k in range(20, 320, 20):
        assert abs(sum(r["src"] == "00" for r in slots[:k]) - k * 200 / 320) < 6


def check_shards(df, shards):
    rows = shard_documents(df, shards).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())
    by_id = {(i, zlib.crc32(t.encode()), len(t.encode()) + 8): t for i, t in texts}
    assert Counter((r["doc_id"], by_id[r["doc_id"], r["text_crc32"], r["size"]]) for r in rows) == texts
    home, slots, load = {}, defaultdict(list), Counter()
    for r in rows:
        text = by_id[r["doc_id"], r["text_crc32"], r["size"]]
        assert home.setdefault(text, r["shard"]) == r["shard"] and 0 <= r["shard"] < shards
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_shards(documents, odd, none):
    load = check_shards(documents, 5)
    assert max(load.values()) < 1.02 * min(load.values())
    check_shards(odd, 24)
    assert shard_documents(none).collect() == []


def test_heap_in_bulk_equals_one_by_one():
    pick = random.Random(2)
    for _ in range(100):
        sizes = sorted((pick.choice([1, 3, 7, 50, 400]) for _ in range(pick.randint(1, 200))), reverse=True)
        classes = [(s, len(list(g)), 0) for s, g in groupby(sizes)]
        classes = [(s, n, s * n) for s, n, _ in classes]
        load, loads = [0] * 6, [0.0] * 6
        for s in sizes:
            load[load.index(min(load))] += s
        for s, cums in lpt(classes, 6):
            for k, n in enumerate(np.diff([0, *cums])):
                loads[k] += s * n
        assert sorted(load) == sorted(loads)


def brute(vectors, every, top):
    out = []
    for q, x in vectors:
        if q % every == 0:
            near = sorted(((-float(np.dot(x, y)), i) for i, y in vectors if i != q))[:top]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    return out


def test_nearest_of_few_is_exact(spark):
    pick = np.random.default_rng(1)
    rows = [(i, [float(x) for x in pick.integers(-4, 5, 6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]
    odd = [(400, None), (420, [0.0] * 6), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (460, [float("nan")] * 6),
           (480, [float("inf")] * 6), (None, [1.0] * 6), (500, [])]
    schema = "vec_id bigint, embedding array<float>, id int, vec int, shard int, q int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows + odd], schema)
    good = [(i, np.array(v)) for i, v in rows if any(v)]
    found = nearest(df, least_shards=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(brute(good, 20, 20))
    few = nearest(df.filter("vec_id < 5 or vec_id is null"), least_shards=3).collect()
    assert [r["vec_id"] for r in few if r["query_id"] == 0] == [
        i for q, _, i, _ in brute([g for g in good if g[0] < 5], 20, 20) if q == 0
    ]
    assert nearest(df.filter("vec_id > 10000")).collect() == []


def test_graph_finds_what_a_scan_finds():
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(12, 24))
    vectors = (centres[pick.integers(0, 12, 3000)] + 0.4 * pick.normal(size=(3000, 24))).astype("f4")
    vectors *= pick.uniform(0.5, 2, (3000, 1)).astype("f4")
    queries = vectors[::50]
    levels = hnsw.build(vectors)
    assert len(levels) > 1 and all(x.links.dtype == np.int32 for x in levels)
    found = hnsw.search(vectors, levels, queries, 128)
    truth = np.argsort(-(queries.astype("f8") @ vectors.astype("f8").T), axis=1)[:, :20]
    hits = [len(set(a[:20]) & set(b)) / 20 for a, b in zip(found, truth, strict=True)]
    assert np.mean(hits) >= 0.9
