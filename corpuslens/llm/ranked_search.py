"""Ranked lexical search by NRA (no random access) over segments of documents.

Documents stay in their task, which cuts its share into segments of a bounded number of postings:
term lists as flat arrays, written to the shared folder as the index. Weights come from counts over
all segments. A segment answers an item by reading its term lists in order of impact, all to the
same depth, and keeping for every document a lower and an upper bound of its score, until no
document outside the best can reach them and the best ones' scores are final. The best of each
segment are merged; as weights hold for the whole corpus, the merged ones are exact.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.llm.common import staged

POSTINGS = 1 << 20  # of a segment; one document's are never divided
BLOCK_TERMS = 50_000  # terms of the items that are sent to the segments together
DEPTH = 256  # postings read of every list at first; four times as many each time
RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"

#: Bytes of UTF-8 text: letters and digits stay, A-Z in lower case, other ASCII ends a term.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())

SEGMENT = (
    "n_docs bigint, n_terms bigint, terms array<binary>, dfs array<int>, ids array<bigint>, "
    "lens binary, docs binary, tfs binary"
)


def terms_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(TERM_BYTES).split()


class _Numbers(dict):
    """Numbers of terms in the order they are first asked for."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class _Segment:
    def __init__(self) -> None:
        self.terms = _Numbers()
        self.ids: list[int | None] = []
        self.lens, self.sizes = array("q"), array("q")  # terms and postings of every document
        self.numbers, self.tfs = array("i"), array("i")

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        counts = Counter(terms)
        self.ids.append(doc_id)
        self.lens.append(len(terms))
        self.sizes.append(len(counts))
        self.numbers.extend(map(self.terms.__getitem__, counts))
        self.tfs.extend(counts.values())

    def row(self) -> pa.RecordBatch:
        """Documents in order of id, so that their places in the segment order ties; lists by term."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), "i4")
        place[order] = np.arange(len(order), dtype="i4")
        docs = np.repeat(place, np.frombuffer(self.sizes, "i8"))
        numbers = np.frombuffer(self.numbers, "i4")
        by_term = np.lexsort((docs, numbers))
        row = {
            "n_docs": (len(self.ids), pa.int64()),
            "n_terms": (sum(self.lens), pa.int64()),
            "terms": (list(self.terms), pa.list_(pa.binary())),
            "dfs": (np.bincount(numbers, minlength=len(self.terms)), pa.list_(pa.int32())),
            "ids": ([self.ids[i] for i in order], pa.list_(pa.int64())),
            "lens": (np.frombuffer(self.lens, "i8")[order].tobytes(), pa.binary()),
            "docs": (docs[by_term].tobytes(), pa.binary()),
            "tfs": (np.frombuffer(self.tfs, "i4")[by_term].tobytes(), pa.binary()),
        }
        return pa.record_batch({c: pa.array([v], kind) for c, (v, kind) in row.items()})


def _indexer(postings: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _Segment()
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = terms_of(raw.as_py())
                if terms:
                    segment.add(doc_id, terms)
                if len(segment.numbers) >= postings:
                    yield segment.row()
                    segment = _Segment()
        if segment.ids:
            yield segment.row()

    return index


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (q, item, term, times)
            for q, item, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for term, times in Counter(terms_of(raw)).items()
        ]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = {"q": pa.int64(), "item_id": pa.int64(), "term": pa.binary(), "times": pa.int64()}
        yield pa.record_batch({c: pa.array(v, k) for (c, k), v in zip(kinds.items(), columns, strict=True)})


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence pattern adds per unit of its term's weight, in 64-bit integers."""
    if 75 * int(n.max(initial=0)) * n_docs >= 1 << 63:
        m = np.array([25 + 75 * x * n_docs // n_terms for x in n.tolist()], dtype="i8")
    else:
        m = 25 + 75 * n * n_docs // n_terms
    tf = tf.astype("i8")
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Best documents (by score, then place) and their scores, from impact-sorted ``(places, scores)``.

    A document's score lies between what was read of it and that plus the last value read of every
    list it was not met in. Reading goes on while a document whose score is not final may belong to
    the best or share the last one's score.
    """
    lower = np.zeros(n_docs, "i8")
    read, depth = 0, DEPTH
    while True:
        front = np.array([scores[depth - 1] if len(scores) > depth else 0 for _, scores in lists], "i8")
        for docs, scores in lists:
            np.add.at(lower, docs[read:depth], scores[read:depth])
        rest = np.full(n_docs, front.sum())
        for (docs, _), last in zip(lists, front.tolist(), strict=True):
            if last:
                rest[docs[:depth]] -= last  # places of a list differ
        last_best = np.partition(lower, n_docs - top)[n_docs - top] if n_docs > top else 0
        if not ((rest > 0) & (lower + rest >= last_best)).any():
            break
        read, depth = depth, 4 * depth
    best = np.flatnonzero(lower >= max(1, last_best))
    best = best[np.lexsort((best, -lower[best]))][:top]
    return best, lower[best]


def _searcher(n_docs: int, n_terms: int, top: int):
    def answer(row: dict) -> Iterator[tuple[int, int | None, int | None, int]]:
        asked = sorted({t["term"] for item in row["items"] for t in item["terms"]})
        found = pc.index_in(pa.array(asked, pa.binary()), value_set=pa.array(row["terms"], pa.binary()))
        number = {t: i for t, i in zip(asked, found.to_pylist(), strict=True) if i is not None}
        stops = np.cumsum(np.array(row["dfs"], "i8"))
        docs, tfs = np.frombuffer(row["docs"], "i4"), np.frombuffer(row["tfs"], "i4")
        lens = np.frombuffer(row["lens"], "i8")
        sorted_lists: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def by_impact(term: bytes) -> tuple[np.ndarray, np.ndarray]:
            if term not in sorted_lists:
                i = number[term]
                at = slice(stops[i] - row["dfs"][i], stops[i])
                impact = impacts(tfs[at], lens[docs[at]], n_docs, n_terms)
                order = np.argsort(-impact, kind="stable")
                sorted_lists[term] = docs[at][order], impact[order]
            return sorted_lists[term]

        for item in row["items"]:
            lists = []
            for t in item["terms"]:
                if t["term"] in number and t["weight"] > 0:
                    places, impact = by_impact(t["term"])
                    lists.append((places, impact * (t["weight"] * t["times"])))
            if lists:
                for doc, score in zip(*nra(lists, row["n_docs"], top), strict=True):
                    yield item["q"], item["item_id"], row["ids"][doc], int(score)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict.fromkeys(("q", "item_id", "doc_id", "score"), pa.int64())
        for batch in batches:
            for i in range(len(batch)):
                found = list(answer(batch.slice(i, 1).to_pylist()[0]))
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.record_batch(
                    {c: pa.array(v, k) for (c, k), v in zip(kinds.items(), columns, strict=True)}
                )

    return search


def build_segments(
    docs: DataFrame, key: str = "doc_id", text: str = "text", postings: int = POSTINGS
) -> DataFrame:
    """The index, staged: one row per segment, each with its own terms, documents and flat lists."""
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("binary").alias("raw"))
    return staged(source.mapInArrow(_indexer(postings), SEGMENT), "search-index")


def search_ranked(
    docs: DataFrame,
    items: DataFrame,
    top: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    postings: int = POSTINGS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of every item, whole numbers.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower
    case. A document scores for every occurrence of its terms in the item's text: weight of the term
    (``1000 ln((2N+2)/(2df+1))``, rounded down) times its saturated frequency. Documents without a
    positive score are not listed; ties go to the smaller key, a null key last. Null and empty texts
    have no terms. Repeated rows are documents of their own, a repeated item row is answered once
    per row. Other columns are ignored; empty tables on either side give no rows.

    Items travel in blocks of about ``block_terms`` terms (one item at least), each broadcast to all
    segments, so that what is sent at once has a bound at any number of items.
    """
    spark = docs.sparkSession
    index = build_segments(docs, key, text, postings)
    asked = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(item_text).cast("binary").alias("raw"))
    asked = asked.select(F.monotonically_increasing_id().alias("q"), "item_id", "raw")
    asked = staged(
        asked.mapInArrow(_item_terms, "q bigint, item_id bigint, term binary, times bigint"), "search-items"
    )
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    blocks = -(-asked.count() // block_terms)
    if not n_docs or not blocks:
        return spark.createDataFrame([], RESULT)
    counts = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select("t.terms", "t.dfs")
    known = asked.select("term").distinct()
    dfs = counts.join(known, counts["terms"] == known["term"]).groupBy("term").agg(F.sum("dfs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df").cast("double") + 1)))
    weighted = asked.join(dfs, "term").groupBy("q", "item_id").agg(
        F.collect_list(F.struct("term", "times", weight.cast("bigint").alias("weight"))).alias("terms")
    )
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    questions = weighted.groupBy(block.alias("block")).agg(
        F.collect_list(F.struct("q", "item_id", "terms")).alias("items")
    )
    questions = staged(questions, "search-blocks")
    payload = index.select("n_docs", "terms", "dfs", "ids", "lens", "docs", "tfs")
    found = None
    for b in range(blocks):
        # One row on the broadcast side: a block of the stated queries, not a product of two tables.
        sent = payload.crossJoin(F.broadcast(questions.filter(F.col("block") == b).select("items")))
        part = sent.mapInArrow(
            _searcher(n_docs, n_terms, top), "q bigint, item_id bigint, doc_id bigint, score bigint"
        )
        found = part if found is None else found.unionAll(part)
    best = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
        .select("item_id", "rank", "doc_id", "score")
    )
