"""Exact deduplication by an extendible-hash index on shared files.

The key of a text is the leading 64 bits of the SHA-256 of its normalised bytes. Keys are counted
by their leading bits, and a directory is doubled until no bucket holds more than its share of
bytes or the directory has ``MAX_DEPTH`` bits. Every task first folds the copies it sees itself,
comparing bytes, so that a hot text leaves a task once. The owner of a bucket, a range of keys, gets
its entries in order of key, chains different texts of one key by comparing bytes, and writes
the bucket's file into the shared folder. Documents then look up their group there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import staged

MAX_DEPTH = 16  # bits of the directory at most: 65,536 entries
BUCKET_BYTES = 64 << 20  # of distinct text in a bucket
RECENT_BYTES = 16 << 20  # of text a task remembers while folding its own copies


def directory(weights: dict[int, int], most: int) -> list[int]:
    """Bucket of every prefix of ``MAX_DEPTH`` bits; a bucket is a run of prefixes.

    Starts with one bucket; a bucket with more than ``most`` splits by its next bit, which doubles
    the directory when the bucket is as deep as the directory.
    """
    sums = [0]
    for prefix in range(1 << MAX_DEPTH):
        sums.append(sums[-1] + weights.get(prefix, 0))
    buckets, todo = [], [(0, 0)]  # (depth, leading bits), leftmost last
    while todo:
        depth, bits = todo.pop()
        width = 1 << (MAX_DEPTH - depth)
        if depth < MAX_DEPTH and sums[(bits + 1) * width] - sums[bits * width] > most:
            todo += [(depth + 1, 2 * bits + 1), (depth + 1, 2 * bits)]
        else:
            buckets.append(width)
    return [bucket for bucket, width in enumerate(buckets) for _ in range(width)]


def _entry(raw: bytes | None, bits: int) -> tuple[int, bytes, bytes]:
    norm = (raw or b"").lower()  # of bytes: A-Z only
    sha = hashlib.sha256(norm).digest()
    return int.from_bytes(sha[:8], "big") >> (64 - bits) << (64 - bits), sha, norm


def dedup_exact(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    key_bits: int = 64,
) -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)``, one row per row of ``df``.

    Texts are equal when their bytes agree after lower-casing A-Z; null counts as empty. The row
    with the largest key stays; of repeated rows with that key, all count as kept. A null key is
    less than any other. An empty table gives no rows. Other columns are ignored. Fewer
    ``key_bits`` make more texts share a key, which changes nothing but the length of the chains.
    """
    source = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("binary").alias("raw"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_entry(raw, key_bits) for raw in batch.column("raw").to_pylist()]
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "key": pa.array([k - (1 << 63) for k, _, _ in found], pa.int64()),
                    "sha": pa.array([sha for _, sha, _ in found], pa.binary()),
                    "size": pa.array([len(norm) for _, _, norm in found], pa.int64()),
                }
            )

    rows = staged(source.mapInArrow(hashed, "id bigint, key bigint, sha binary, size bigint"), "dedup-rows")
    prefix = (F.shiftright("key", 64 - MAX_DEPTH) + (1 << (MAX_DEPTH - 1))).cast("int")
    distinct = rows.groupBy("key", "sha").agg(F.first("size").alias("size"))
    weights = distinct.groupBy(prefix.alias("prefix")).agg(F.sum(F.col("size") + 64).alias("w"))
    owners = directory({r["prefix"]: r["w"] for r in weights.collect()}, bucket_bytes)
    buckets = owners[-1] + 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a task: one per distinct text among those it remembers."""
        recent: dict[int, list[list]] = {}
        held = 0
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for doc, raw in zip(ids, batch.column("raw").to_pylist(), strict=True):
                k, sha, norm = _entry(raw, key_bits)
                chain = recent.setdefault(k, [])
                for link in chain:
                    if link[1] == norm:
                        link[2] += 1
                        link[3] = doc if link[3] is None else max(link[3], link[3] if doc is None else doc)
                        break
                else:
                    chain.append([sha, norm, 1, doc])
                    held += len(norm) + 200
            if held > RECENT_BYTES:
                yield from entries(recent)
                recent, held = {}, 0
        yield from entries(recent)

    def entries(recent: dict[int, list[list]]) -> Iterator[pa.RecordBatch]:
        flat = [(k, *link) for k, chain in recent.items() for link in chain]
        for at in range(0, len(flat), 1000):
            k, sha, norm, n, top = zip(*flat[at : at + 1000], strict=True)
            yield pa.record_batch(
                {
                    "bucket": pa.array([owners[x >> (64 - MAX_DEPTH)] for x in k], pa.int32()),
                    "key": pa.array([x - (1 << 63) for x in k], pa.int64()),
                    "sha": pa.array(sha, pa.binary()),
                    "norm": pa.array(norm, pa.large_binary() if sum(map(len, norm)) >> 31 else pa.binary()),
                    "n": pa.array(n, pa.int64()),
                    "top": pa.array(top, pa.int64()),
                }
            )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of a range of keys: different texts of a key follow each other in its chain."""
        now, links = None, []
        done: list[tuple] = []

        def close() -> None:
            done.extend((now[0], now[1], i, *link[:1], *link[2:]) for i, link in enumerate(links))

        def groups() -> pa.RecordBatch:
            b, k, i, sha, n, top = zip(*done, strict=True)
            names = {"bucket": (b, pa.int32()), "key": (k, pa.int64()), "link": (i, pa.int32())}
            names |= {"sha": (sha, pa.binary()), "n": (n, pa.int64()), "top": (top, pa.int64())}
            return pa.record_batch({c: pa.array(v, t) for c, (v, t) in names.items()})

        for batch in batches:
            for row in batch.to_pylist():
                if now != (row["bucket"], row["key"]):
                    if now:
                        close()
                    now, links = (row["bucket"], row["key"]), []
                for link in links:
                    if link[1] == row["norm"]:
                        link[2] += row["n"]
                        link[3] = max(link[3], row["top"], key=lambda x: (x is not None, x or 0))
                        break
                else:
                    links.append([row["sha"], row["norm"], row["n"], row["top"]])
            if len(done) > 10_000:
                yield groups()
                done.clear()
        if now:
            close()
        if done:
            yield groups()

    folded = source.mapInArrow(
        fold, "bucket int, key bigint, sha binary, norm binary, n bigint, top bigint"
    )
    index = staged(
        folded.repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", "key")
        .mapInArrow(chain, "bucket int, key bigint, link int, sha binary, n bigint, top bigint"),
        "dedup-index",
        by=["bucket"],
    )
    groups = index.select("key", "sha", F.col("top").alias("keep_id"), F.col("n").alias("group_size"))
    return rows.join(groups, ["key", "sha"]).select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
