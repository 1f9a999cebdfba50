"""Exact deduplication and the Jaccard join against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpuslens.llm import jaccard_join
from corpuslens.llm.components import components
from corpuslens.llm.exact_dedup import MAX_DEPTH, dedup_exact, directory
from corpuslens.llm.jaccard_join import cells_of, link_documents, link_sets


def exact(rows):
    norm = [((t or "").encode().lower(), i) for i, t in rows]
    sizes = Counter(n for n, _ in norm)
    keep = {}
    for n, i in norm:
        keep[n] = max(keep.get(n), i, key=lambda x: (x is not None, x or 0))
    return [(i, keep[n], sizes[n], i == keep[n], hashlib.sha256(n).hexdigest()) for n, i in norm]


def check_exact(df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    found = dedup_exact(df, **options).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(exact(rows), key=repr)


def test_exact_dedup(documents, odd, none):
    check_exact(documents)
    check_exact(odd)
    assert dedup_exact(none).collect() == []


def test_splits_and_chains(documents):
    check_exact(documents, bucket_bytes=20_000)
    check_exact(documents, bucket_bytes=20_000, key_bits=3)


def test_directory_doubles_where_it_is_full():
    owners = directory({0: 5, 1: 5, 1 << (MAX_DEPTH - 1): 3}, 6)
    assert len(owners) == 1 << MAX_DEPTH and owners == sorted(owners)
    assert owners[0] != owners[1] and owners[1 << (MAX_DEPTH - 1)] == owners[-1]


def linked(rows, percent=85, width=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def check_linked(df, **options):
    rows = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None}
    want = linked(rows.items())
    found = link_documents(df, **options).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == want
    assert len(found) == df.count() and all(r["component_id"] is None for r in found if r["doc_id"] is None)


def test_join_of_documents(documents, odd, none):
    check_linked(documents)
    check_linked(odd)
    assert link_documents(none).collect() == []


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(jaccard_join, "REGION", 3)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    monkeypatch.setattr(jaccard_join, "SEEN", 2)


def test_large_regions_and_families_are_split(spark, narrow):
    pick = random.Random(1)
    rows, n = [], 0
    for _ in range(4):
        base = [f"t{pick.randrange(500)}" for _ in range(60)]
        for _ in range(25):
            text = list(base)
            for _ in range(pick.randrange(6)):
                text[pick.randrange(60)] = f"t{pick.randrange(500)}"
            rows.append((n, " ".join(text)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_linked(df, family=500)
    check_linked(df, family=100)


def test_links_in_memory_connect_what_all_pairs_connect():
    pick = np.random.default_rng(2)
    base = pick.integers(0, 1 << 40, 200)
    sets = [np.unique(np.concatenate([pick.choice(base, 60, False), pick.integers(0, 90, 30)])).astype("u8") for _ in range(60)]
    sets += [np.unique(np.append(s[: len(s) - k % 9], k)).astype("u8") for k, s in enumerate(sets)]

    def classes(links):
        root = list(range(len(sets)))
        for a, b in links:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return [root.index(r) for r in root]

    every = [(a, b) for a in range(len(sets)) for b in range(a)
             if 100 * (o := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - o)]
    assert classes(link_sets(sets, 85)) == classes(every)


def regions_of(texts, percent=85, width=4):
    """Entries of all texts, as a task of regions gets them, and what it makes of them."""
    raw = pa.array([t.encode() for t in texts], pa.binary())
    batches = [pa.record_batch({"raw": raw[i : i + 100]}) for i in range(0, len(raw), 100)]
    prefix = jaccard_join._prefixer(width, percent, np.empty(0, "u8"), np.empty(0, "i8"))
    entries = pa.Table.from_batches(prefix(iter(batches)))
    by_region = entries.sort_by([("shingle", "ascending"), ("node", "ascending")])
    made = jaccard_join._region_join(percent)(iter(by_region.to_batches(max_chunksize=500)))
    return entries, pa.Table.from_batches(made).to_pydict()


def varied(pick, words, share):
    return [f"t{pick.randrange(10**6)}" if pick.random() < share else w for w in words]


def test_pairs_of_near_copies_grow_with_the_documents():
    pick = random.Random(6)
    base = [f"{'w' * pick.randrange(1, 9)}{pick.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join([*base, f"copy{k}"]) for k in range(60)]
    assert len(regions_of(texts)[1]["a"]) < 10 * len(texts)
    pipeline = regions_of(texts, corpus_pipeline.PERCENT, corpus_pipeline.WORDS)
    assert len(pipeline[1]["a"]) < 10 * len(texts)


def test_regions_of_near_copies_lie_in_few_tasks():
    pick = random.Random(7)
    base = [f"{'w' * pick.randrange(1, 9)}{pick.randrange(10**6)}" for _ in range(400)]
    found = regions_of([" ".join(base)])[0].to_pydict()
    regions = [r >> 40 for r, n in zip(found["shingle"], found["n"], strict=True) if n]
    assert 4 * len(set(regions)) < 3 * len(regions)


def test_a_link_of_a_large_region_is_kept_where_the_pair_also_meets_elsewhere(monkeypatch):
    monkeypatch.setattr(jaccard_join, "REGION", 2)
    rows = {"shingle": [1, 1, 2, 2, 2], "node": [5, 6, 5, 6, 7], "n": [90] * 5}
    batch = pa.record_batch({k: pa.array(v, pa.int64()) for k, v in rows.items()})
    made = pa.Table.from_batches(jaccard_join._region_join(85)(iter([batch]))).to_pylist()
    assert {(r["a"], r["b"]): r["need"] for r in made} == {(5, 6): 0, (5, 7): 0}


def test_sets_of_members_travel_in_the_shorter_form():
    pick = random.Random(9)
    texts = [" ".join(varied(pick, [""] * 400, 1)), "é" * 5000 + " " + " ".join(varied(pick, ["b"] * 3, 1))]
    shingles = jaccard_join._shingler(4)
    keys = [jaccard_join._set_key(shingles(t.encode())[0]) for t in texts]
    raw = pa.record_batch({"id": pa.array([1, 2]), "raw": pa.array([t.encode() for t in texts], pa.binary())})
    (texts_packed,) = jaccard_join._packer(iter([raw]))
    ones = {c: pa.array([1, 2]) for c in ("family", "rep", "n")}
    joined = pa.record_batch({**ones, "key": pa.array(keys), "packed": texts_packed.column("packed")})
    (members,) = jaccard_join._attacher(4)(iter([joined]))
    packed = members.column("packed").to_pylist()
    assert [p[:1] for p in packed] == [jaccard_join.TEXT, jaccard_join.SHINGLES]
    for text, p in zip(texts, packed, strict=True):
        found = shingles(text.encode())[0]
        assert (jaccard_join._unpacker(4)(p) == found).all() and len(p) <= 1 + found.nbytes


def test_families_of_many_near_copies(spark):
    pick = random.Random(8)
    rows = []
    for _ in range(6):
        base = [f"{'w' * pick.randrange(1, 6)}{pick.randrange(300)}" for _ in range(pick.randrange(20, 90))]
        for k in range(30):
            text = varied(pick, base, pick.choice([0, 0.01, 0.03]))
            rows.append((len(rows), " ".join(text[: len(text) - pick.choice([0, 1, k % 8])])))
    long = "wwwwwwwwwwwwwww1 wwwwwwwwwwwwwww2 wwwwwwwwwwwwwww3 wwwwwwwwwwwwwww4 wwwwwwwwwwwwwww5"
    for k in range(30):  # one vertex by their longest words, not similar
        rows.append((len(rows), f"{long} " + " ".join(f"x{k}y{i}" for i in range(20))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_linked(df)
    check_linked(df, family=3000)


def test_similar_documents_share_a_cell():
    pick = np.random.default_rng(4)
    for _ in range(500):
        far = pick.random(4)
        near = np.clip(far + pick.uniform(-0.15, 0.15, 4), 0, 1)
        assert set(cells_of(far, 0.15)) & set(cells_of(near, 0.15))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert {r["node"]: r["component"] for r in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
