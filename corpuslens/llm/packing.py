"""Best-fit packing after a dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is its histogram, which has at most
``capacity`` rows for any corpus. On it, sets that provably belong to some best packing are fixed
and leave the instance (Martello and Toth): two documents that fill a sequence exactly; a document
with the longest partner that fits, when nothing that could stand in the partner's place is
longer. The rest is packed best fit, longest first. The plan says for runs of equal lengths where
they go; documents find their place by their rank among the documents of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.llm.common import staged
from corpuslens.llm.tokens import word_ids

#: length, first and last rank (exclusive), first sequence, documents per sequence, offset
Run = tuple[int, int, int, int, int, int]


class Plan:
    """Runs of a packing, and the ranks and sequences given out so far."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.given: Counter[int] = Counter()
        self.runs: list[Run] = []

    def put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        first = self.given[length]
        self.runs.append((length, first, first + n, sequence, each, offset))
        self.given[length] += n
        self.left[length] -= n

    def reduce(self) -> None:
        """Fix what dominates; a fixed sequence is closed."""
        cap = self.capacity
        for length in range(cap, 0, -1):
            while self.left[length]:
                room = cap - length
                self.left[length] -= 1
                partner = next((x for x in range(room, 0, -1) if self.left[x]), 0)
                small = self._smallest(3)
                self.left[length] += 1
                if not partner:
                    self._fix(length, 0, self.left[length])
                    continue
                exact = partner == room
                alone = len(small) < 2 or small[0] + small[1] > room
                if not (exact or alone or self._beats_pairs(length, partner, room, small)):
                    break
                n = self.left[length] // 2 if partner == length else min(self.left[length], self.left[partner])
                self._fix(length, partner, n)

    def _smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for x, n in enumerate(self.left):
            out += [x] * min(n, k - len(out))
            if len(out) == k:
                break
        return out

    def _beats_pairs(self, length: int, partner: int, room: int, small: list[int]) -> bool:
        """At most two others fit beside ``length``, and no such two are longer than ``partner``."""
        if len(small) > 2 and sum(small) <= room:
            return False
        here = [x for x in range(1, room) if self.left[x] - (x == length) > 0]
        low, high, best = 0, len(here) - 1, 0
        while low <= high:
            pair = here[low] + here[high]
            if pair > room:
                high -= 1
            elif low == high and self.left[here[low]] - (here[low] == length) < 2:
                break
            else:
                best = max(best, pair)
                low += 1
        return best <= partner

    def _fix(self, length: int, partner: int, n: int) -> None:
        if partner == length:
            self.put(length, 2 * n, self.sequences, 2, 0)
        else:
            self.put(length, n, self.sequences, 1, 0)
            if partner:
                self.put(partner, n, self.sequences, 1, length)
        self.sequences += n
        self.fixed += n

    def best_fit(self) -> None:
        """Longest first into the fullest open sequence with room, many alike at once."""
        rooms: list[int] = []  # in order
        open_: dict[int, list[tuple[int, int]]] = {}  # room: first sequence and how many

        def leave(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in open_:
                    open_[room] = []
                    insort(rooms, room)
                open_[room].append((first, n))

        for length in range(self.capacity, 0, -1):
            while n := self.left[length]:
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, many = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                        rooms.pop(at)
                else:
                    room, first = self.capacity, self.sequences
                    many = -(-n // (room // length))
                    self.sequences += many
                each = room // length
                full = min(many, n // each)
                if full:
                    self.put(length, full * each, first, each, self.capacity - room)
                    leave(room - each * length, first, full)
                rest = min(n - full * each, each) if full < many else 0
                if rest:
                    self.put(length, rest, first + full, rest, self.capacity - room)
                    leave(room - rest * length, first + full, 1)
                leave(room, first + full + (rest > 0), many - full - (rest > 0))


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan


def cut_documents(
    df: DataFrame, vocabulary: str, capacity: int, key: str, text: str, end_id: int, with_ids: bool
) -> DataFrame:
    """``(id, piece, start, length, crc[, ids], task, rank)``: documents as token pieces.

    ``rank`` counts the pieces of a length within the task that cut them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task = word_ids(vocabulary), TaskContext.get().partitionId()
        met: Counter[int] = Counter()
        tail = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                docs = ids_of.many([t or "" for t in batch.column("text").to_pylist()])
                rows = []
                for doc, ids in zip(batch.column("id").to_pylist(), docs, strict=True):
                    ids += tail
                    for piece, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[begin : begin + 4 * capacity]
                        n = len(part) // 4
                        rows.append((doc, piece, begin // 4, n, zlib.crc32(part), task, met[n], part))
                        met[n] += 1
                doc, piece, start, n, crc, tasks, rank, parts = zip(*rows, strict=True)
                out = {
                    "id": pa.array(doc, pa.int64()),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(n, pa.int64()),
                    "crc": pa.array(crc, pa.int64()),
                    "task": pa.array(tasks, pa.int32()),
                    "rank": pa.array(rank, pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(p, "<u4") for p in parts], pa.list_(pa.int64()))
                yield pa.record_batch(out)

    schema = "id bigint, piece int, start bigint, length bigint, crc bigint, task int, rank bigint"
    source = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(cut, schema + ", ids array<bigint>" * with_ids)


def pack_documents(
    df: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Every document in sequences of at most ``capacity`` tokens, in as few as the method can.

    Returns ``(key, piece, start, length, ids_crc32, sequence_id, offset[, ids])``. A document is
    its ids by the tokenizer file ``vocabulary`` and ``end_id``; only longer ones are cut, into
    pieces of ``capacity`` and a rest. Null and empty texts are the end id alone; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored. ``ids`` are the piece's
    own token ids.
    """
    pieces = staged(cut_documents(df, vocabulary, capacity, key, text, end_id, with_ids), "pack-pieces")
    counts = staged(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity``
    plan = plan_packing({r["length"]: r["n"] for r in lengths}, capacity)
    runs = np.array(sorted(plan.runs), "i8").reshape(-1, 6)
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = runs[:, 0] * (1 << 48) + runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            run = runs[np.searchsorted(marks, length * (1 << 48) + rank, "right") - 1]
            within = rank - run[:, 1]
            sequence = run[:, 3] + within // run[:, 4]
            offset = run[:, 5] + within % run[:, 4] * length
            cols = {c: batch.column(c) for c in kept}
            yield pa.record_batch(cols | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    kept = ["id", "piece", "start", "length", "crc"] + ["ids"] * with_ids
    schema = "id bigint, piece int, start bigint, length bigint, crc bigint" + ", ids array<bigint>" * with_ids
    placed = pieces.join(offsets, ["task", "length"]).mapInArrow(
        place, schema + ", sequence_id bigint, offset bigint"
    )
    names = {"id": key, "crc": "ids_crc32"}
    order = ["id", "piece", "start", "length", "crc", "sequence_id", "offset"] + ["ids"] * with_ids
    return placed.select(*[F.col(c).alias(names.get(c, c)) for c in order])
