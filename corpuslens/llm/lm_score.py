"""Katz backoff scores of texts: Good-Turing discounted bigrams over discounted words.

The work is laid out so that tokens stay with their block. Tasks sort the tokens of a block of
documents into pairs (word, the word before); of each pair only its training count goes to the part
of the word, once per block however often the pair occurs; the documents of its tokens go along,
packed, so that nothing has to be kept elsewhere. A part adds up the counts of its pairs and words,
builds its piece of the n-gram table and sends the counts back to the blocks, which add up, per
document, the logarithms that depend on them; what a discount multiplies is added up as a number of
tokens per count. Only backing off needs the word before: each part reports what it has seen after
a history, these reports add up to the exactly normalised backoff weight of the history, and only
tokens in unseen pairs are joined with it. The counts of counts come last, and the sums turn into
scores. Pairs are written once on their way to the parts and once on their way back.

Frequent words (training counts of ``1 / HOT_SHARE`` of all tokens or a quarter of a part) are split
over parts by the word before; they are found by counting words first: all of them in ``BUCKETS`` by
their hash, then one by one those of buckets that may hold a frequent word. Words are known by 64
bits of their hash, common ones by their place in a list, as pairs are mostly of these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10
from struct import calcsize, pack, unpack_from

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import crc32_fold, staged

FOLDS, HELD_OUT = 7, 2
CUT = 5  # counts above it are not discounted (Katz)
BLOCK_TOKENS, BLOCK_DOCS = 1_500_000, 32_000  # of a block a task sorts at once
PART_TOKENS = 1_700_000  # of a part on average
LEAST_PARTS = 12
HOT_SHARE = 512  # a word with 1/512 of all tokens is hot
BUCKETS = 1 << 16  # of words, counted together
COMMON_SHARE = 1 << 18  # a word with 1/2^18 of all tokens is common, if it has
COMMON_TIMES = 4  # in a block
CODES = 1 << 20  # keys below it are marks and common words
START, END = 0, 1  # keys of the place before a text and of its end
R = [f"r{k}" for k in range(1, CUT + 1)]  # tokens in pairs seen k times
U = [f"u{k}" for k in range(CUT + 1)]  # tokens in unseen pairs whose word was seen k times
SUMS = ["s0", "known", "a", *R, "unseen", "b", *U]
HISTORY = ["big", *R, "mass", *U[1:]]  # what was seen after a history


class Words(dict):
    """Numbers of words in order of appearance; the first two are the marks."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.names.append(word)
        self[word] = n = len(self.names) + 1
        return n

    def keys64(self) -> np.ndarray:
        hashes = map(word_key, self.names)
        return np.concatenate([np.array([START, END], "u8"), np.fromiter(hashes, "u8", len(self.names))])


class Block:
    """Documents whose tokens are sorted together."""

    def __init__(self) -> None:
        self.words, self.docs, self.size = Words(), [], 0

    def add(self, doc: int | None, train: bool, raw: bytes | None) -> None:
        found = (raw or b"").lower().split()
        tokens = np.fromiter(map(self.words.__getitem__, found), "i4", len(found))
        self.docs.append((doc, train, tokens))
        self.size += len(found) + 1

    def full(self) -> bool:
        return self.size >= BLOCK_TOKENS or len(self.docs) >= BLOCK_DOCS

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all tokens, of the words before them, and of their documents."""
        end, start = np.array([END], "i4"), np.array([START], "i4")
        now = np.concatenate([x for _, _, t in self.docs for x in (t, end)])
        before = np.concatenate([x for _, _, t in self.docs for x in (start, t)])
        lengths = [len(t) + 1 for _, _, t in self.docs]
        return now, before, np.repeat(np.arange(len(lengths), dtype="i4"), lengths)

    def train(self) -> np.ndarray:
        return np.array([t for _, t, _ in self.docs], bool)


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, bytes | None]]:
    """Rows of the columns ``id``, ``train`` and ``raw``; few texts at a time are objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            some = batch.slice(lo, 500)
            yield from zip(*(some.column(c).to_pylist() for c in ("id", "train", "raw")), strict=True)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block = Block()
    for row in texts(batches):
        block.add(*row)
        if block.full():
            yield block
            block = Block()
    if block.docs:
        yield block


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


END_WORD = b"\n"  # stands for the end where words are named


def word_key(word: bytes) -> int:
    return END if word == END_WORD else max(xxhash.xxh64_intdigest(word), CODES)


def coded(keys: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Keys, those in the sorted list ``common`` as their places in it."""
    if not len(common):
        return keys
    at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
    return np.where(common[at] == keys, at.astype("u8") + np.uint64(END + 1), keys)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """Per block its tokens, the words of its training tokens, their keys, and how often they occur."""
    counts: Counter[bytes] = Counter()
    tokens = 0

    def found() -> tuple[int, list[bytes], np.ndarray, np.ndarray]:
        keys = np.fromiter(map(word_key, counts), "u8", len(counts))
        return tokens, list(counts), keys, np.fromiter(counts.values(), "i8", len(counts))

    for _, train, raw in texts(batches):
        words = (raw or b"").lower().split()
        tokens += len(words) + 1
        if train:
            counts.update(words)
            counts[END_WORD] += 1
        if tokens >= BLOCK_TOKENS:
            yield found()
            counts.clear()
            tokens = 0
    if tokens:
        yield found()


def buckets(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) % np.uint64(BUCKETS)).astype("i8")


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block its tokens (no bucket), and the training tokens of every bucket."""
    for tokens, _, keys, times in _word_counts(batches):
        sums = np.bincount(buckets(keys), times, BUCKETS).astype("i8")
        some = np.flatnonzero(sums)
        yield pa.record_batch(
            {
                "bucket": pa.array([None, *some.tolist()], pa.int32()),
                "n": pa.array(np.r_[tokens, sums[some]], pa.int64()),
            }
        )


def _counted(heavy: np.ndarray):
    """Per block the words of its training tokens that are in ``heavy`` buckets; of others that occur
    ``COMMON_TIMES``, the keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, keys, times in _word_counts(batches):
            whole = np.isin(buckets(keys), heavy)
            some = np.flatnonzero(whole | (times >= COMMON_TIMES))
            yield pa.record_batch(
                {
                    "word": pa.array([words[i] if whole[i] else None for i in some], pa.binary()),
                    "key": pa.array(keys[some].view("i8")),
                    "n": pa.array(times[some]),
                }
            )

    return work


def counted_words(rows: DataFrame) -> tuple[int, dict[bytes, int], np.ndarray]:
    """All tokens, the training counts of words too frequent for one part, and keys of common words."""
    found = rows.mapInArrow(_bucket_counts, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    sums = {r["bucket"]: r["n"] for r in found.collect()}  # of BUCKETS at most
    tokens = sums.pop(None, 0)
    least = min(-(-tokens // HOT_SHARE), PART_TOKENS // 4)
    heavy = np.array([b for b, n in sums.items() if n >= least], "i8")
    words = rows.mapInArrow(_counted(heavy), "word binary, key bigint, n bigint").groupBy("word", "key")
    often = min(least, -(-tokens // COMMON_SHARE))
    found = words.agg(F.sum("n").alias("n")).filter(F.col("n") >= often)
    found = found.select(F.when(F.col("n") >= least, F.col("word")).alias("word"), "key", "n").toArrow()
    hot = found.filter(pc.is_valid(found["word"]))
    keys = np.unique(found["key"].to_numpy().view("u8"))
    return tokens, dict(zip(hot["word"].to_pylist(), hot["n"].to_pylist(), strict=True)), keys[keys > END][: CODES - 2]


def frequent_words(rows: DataFrame) -> tuple[int, dict[bytes, int]]:
    """All tokens, and the training counts of words too frequent for one part."""
    return counted_words(rows)[:2]


HEAD = "<IIB"


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of their bytes, the upper ones that are all zero left out, compressed
    where that makes them smaller."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    raw = values.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T.tobytes()
    body = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
    return pack(HEAD, min(len(body), len(raw)), len(values), width) + (body if len(body) < len(raw) else raw)


def _from_planes(raw: memoryview) -> tuple[np.ndarray, memoryview]:
    """The numbers at the start of ``raw``, and what follows."""
    size, n, width = unpack_from(HEAD, raw)
    raw = raw[calcsize(HEAD) :]
    out = np.zeros((n, 8), "u1")
    if size:
        planes = raw[:size]
        if size < n * width:
            planes = pa.decompress(planes, decompressed_size=n * width, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, "u1").reshape(width, n).T
    return out.view("<u8").reshape(-1), raw[size:]


def dense(values: np.ndarray) -> bytes:
    """Numbers that are not negative, in few bytes: in order as their differences, keys that repeat as
    their places in the list of different ones."""
    values = values.astype("u8")
    if len(values) > 1 and (values[1:] >= values[:-1]).all():
        return b"s" + _planes(np.diff(values, prepend=np.uint64(0)))
    if len(values) and values.max() >> np.uint64(32):
        keys, places = np.unique(values, return_inverse=True)
        if 4 * len(keys) < 3 * len(values):
            return b"k" + _planes(np.diff(keys, prepend=np.uint64(0))) + _planes(places)
    return b"p" + _planes(values)


def plain(raw: bytes, kind: str) -> np.ndarray:
    """What :func:`dense` was given, as an array of ``kind``."""
    form, (values, rest) = raw[:1], _from_planes(memoryview(raw)[1:])
    if form != b"p":
        values = np.cumsum(values, dtype="u8")
    if form == b"k":
        values = values[_from_planes(rest)[0]]
    return values.astype(kind)


#: Of a block and part: words, how many pairs each has, the words before, training tokens of the
#: pairs; tokens of the pairs, and the documents of these tokens. Parts hand on ``KEPT`` as it is.
PAIRS = (
    "part int, block bigint, word binary, fan binary, before binary, trained binary, times binary, docs binary, "
    "ids array<bigint>, sizes binary"
)


NUMBERS = {"word": "u8", "fan": "u4", "before": "u8", "trained": "u4", "times": "u4", "docs": "u2", "sizes": "i8"}
KEPT = ["part", "fan", "times", "docs", "ids", "sizes"]


def pair_order(part: np.ndarray, now: np.ndarray, before: np.ndarray, parts: int, words: int) -> np.ndarray:
    """Order of tokens by part, word and the word before; one key where the three fit in one."""
    if parts * words * words < 1 << 63:
        return np.argsort((part * words + now) * words + before, kind="stable")
    return np.lexsort((before, now, part))


def _sorter(parts: int, hot: np.ndarray, common: np.ndarray = np.empty(0, "u8")):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, block in enumerate(blocks(batches)):
            now, before, doc = block.tokens()
            keys = coded(block.words.keys64(), common)
            home = (mixed(keys) % np.uint64(parts)).astype("i4")
            part = home[now]
            split = np.isin(keys, hot)[now]
            part[split] = mixed(keys[now[split]] ^ mixed(keys[before[split]])) % np.uint64(parts)
            order = pair_order(part.astype("i8"), now, before, parts, len(keys))
            sizes, train = np.bincount(doc, minlength=len(block.docs)), block.train()
            marked = (2 * np.arange(len(train)) + train).astype("u2")  # of a document, with its fold
            part, now, before, doc = part[order], now[order], before[order], marked[doc[order]]
            first = np.flatnonzero(np.r_[True, (now[1:] != now[:-1]) | (before[1:] != before[:-1])])
            stop = np.r_[first, len(now)]
            part, now, before = part[first], now[first], before[first]
            trained = np.add.reduceat(doc % 2, first, dtype="u4")
            doc = doc >> 1
            where = np.searchsorted(part, np.arange(parts + 1))
            me = (task << 20) | number
            for p in range(parts):
                lo, hi = where[p], where[p + 1]
                tells = p == me % parts
                if lo == hi and not tells:
                    continue
                words = now[lo:hi]
                head = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if hi > lo else np.empty(0, int)
                yield pa.record_batch(
                    {
                        "part": pa.array([p], pa.int32()),
                        "block": pa.array([me], pa.int64()),
                        "word": pa.array([keys[words[head]].tobytes()]),
                        "fan": pa.array([np.diff(np.r_[head, hi - lo]).astype("u4").tobytes()]),
                        "before": pa.array([keys[before[lo:hi]].tobytes()]),
                        "trained": pa.array([trained[lo:hi].tobytes()]),
                        "times": pa.array([np.diff(stop[lo : hi + 1]).astype("u4").tobytes()]),
                        "docs": pa.array([doc[stop[lo] : stop[hi]].tobytes()]),
                        "ids": pa.array([[d for d, _, _ in block.docs] if tells else None], pa.list_(pa.int64())),
                        "sizes": pa.array(
                            [(2 * sizes + train).astype("i8").tobytes() if tells else None], pa.binary()
                        ),
                    }
                )

    return sort


def _dense_pairs(sort):
    """The pairs of :func:`_sorter` with their numbers in few bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sort(batches):
            for name, kind in NUMBERS.items():
                column = batch.column(name).to_pylist()
                column = [None if x is None else dense(np.frombuffer(x, kind)) for x in column]
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(column, pa.binary()))
            yield batch

    return work


#: Of a part, by where they go (``home``): counts for a block with what the block had sent along,
#: what was seen after the histories of a part, and counts of counts.
BINARY = ("fan", "seen", "count", "lost", "times", "docs", "sizes", "keys", "history")
OUT = "kind string, home bigint, part int, ids array<bigint>, counts array<bigint>"
OUT += "".join(f", {c} binary" for c in BINARY)
KIND = {"home": pa.int64(), "part": pa.int32(), "ids": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
KIND |= dict.fromkeys(BINARY, pa.binary())
SUMMED = (
    "kind string, rid bigint, id bigint, n_tokens bigint, held boolean, "
    + ", ".join(f"{c} double" for c in SUMS)
    + ", key bigint, n double, keys binary, history binary, counts array<bigint>"
)
DOC = {"rid": pa.int64(), "id": pa.int64(), "n_tokens": pa.int64(), "held": pa.bool_()}
DOC |= dict.fromkeys(SUMS, pa.float64())
DOC |= {"key": pa.int64(), "n": pa.float64()}
DOC |= {"keys": pa.binary(), "history": pa.binary(), "counts": pa.list_(pa.int64())}


def _row(kind: str, rows: int, types: dict[str, pa.DataType], /, **given) -> pa.RecordBatch:
    out = {"kind": pa.array([kind] * rows, pa.string())}
    for name, type_ in types.items():
        out[name] = pa.array(given[name], type_) if name in given else pa.nulls(rows, type_)
    return pa.record_batch(out)


def _grouped(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of every value of a sorted array, and the number of the value at each place."""
    new = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(sorted_) else np.empty(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _part(parts: int, hot: np.ndarray, hot_counts: np.ndarray):
    order = np.argsort(hot)
    hot, hot_counts = hot[order], hot_counts[order]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, before, trained, sent = [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                sent.append((row["block"], {c: [row[c]] for c in KEPT}))
                word.append(np.repeat(plain(row["word"], "u8"), plain(row["fan"], "u4")))
                before.append(plain(row["before"], "u8"))
                trained.append(plain(row["trained"], "u4"))
        if not sent:
            return
        ends = np.cumsum([0, *map(len, before)])
        word, before, trained = map(np.concatenate, (word, before, trained))
        # pairs of all blocks in order, and the pair of every entry
        order = np.lexsort((before, word))
        rank = np.empty(len(order), "i8")
        w, v = word[order], before[order]
        new = np.r_[True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])] if len(w) else np.empty(0, bool)
        rank[order] = np.cumsum(new) - 1
        w, v = w[new], v[new]
        seen = np.bincount(rank, trained, len(w)).astype("i8")
        del word, before, trained, order
        head, number = _grouped(w)
        count = np.add.reduceat(seen, head) if len(head) else np.empty(0, "i8")
        name = w[head]
        at = np.searchsorted(hot, name)
        is_hot = np.zeros(len(name), bool)
        if len(hot):
            is_hot = hot[np.minimum(at, len(hot) - 1)] == name
            count[is_hot] = hot_counts[at[is_hot]]
        # what this part adds to the counts of counts: words by count, words, tokens, pairs by count
        own = count[~is_hot]
        few = np.bincount(np.minimum(own, CUT + 2), minlength=CUT + 3)
        pairs = np.bincount(np.minimum(seen, CUT + 2), minlength=CUT + 3)
        yield _row("cc", 1, KIND, home=[0], counts=[[*few[1:-1], (own > 0).sum(), own.sum(), *pairs[1:-1]]])
        # back to the blocks
        for (block, kept), lo, hi in zip(sent, ends[:-1], ends[1:], strict=True):
            mine, fan = rank[lo:hi], plain(kept["fan"][0], "i8")
            r, first = seen[mine], mine[np.cumsum(fan) - fan]  # pair of every word
            yield _row("back", 1, KIND, home=[block], seen=[dense(r)], count=[dense(count[number[first]])],
                       lost=[dense(v[mine[r == 0]])], **kept)
        del rank
        # what was seen after each history
        known = np.flatnonzero(seen)
        known = known[np.argsort(v[known], kind="stable")]
        head, number_v = _grouped(v[known])
        r, c = seen[known], count[number[known]]

        def total(mask: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(number_v[mask], None if weight is None else weight[mask], len(head)).astype("f8")

        columns = [total(r > CUT, r), *(total(r == k) for k in range(1, CUT + 1))]
        columns += [total(c > CUT, c), *(total(c == k) for k in range(1, CUT + 1))]
        table = np.stack(columns, 1) if len(head) else np.empty((0, len(HISTORY)))
        keys = v[known][head]
        home = mixed(keys) % np.uint64(parts)
        order = np.argsort(home, kind="stable")
        where = np.searchsorted(home[order], np.arange(parts + 1))
        for p in range(parts):
            some = order[where[p] : where[p + 1]]
            if len(some):
                yield _row("hist", 1, KIND, home=[p], keys=[dense(keys[some])],
                           history=[dense(table[some].T.reshape(-1))])

    return work


def _sums(back: pa.Table) -> pa.Table:
    """Sums of the documents of a block, and their tokens in unseen pairs by history."""
    back = back.sort_by("part")

    def joined(name: str, type_: str) -> np.ndarray:
        return np.concatenate([plain(x, type_) for x in back.column(name).to_pylist()])

    times, docs = joined("times", "u4"), joined("docs", "i8")
    own = back.filter(pc.is_valid(back.column("ids"))).to_pylist()[0]
    n, sizes = len(own["ids"]), plain(own["sizes"], "i8")
    if not np.array_equal(np.bincount(docs, minlength=n), sizes // 2):
        raise ValueError("a task that ran again had its rows in another order; write the input to files first")
    rids = np.arange(n) + (own["home"] << 16)
    seen = joined("seen", "i8")
    r, c = np.repeat(seen, times), np.repeat(np.repeat(joined("count", "i8"), joined("fan", "i8")), times)

    def add(mask: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(docs[mask], None if weight is None else weight[mask], n).astype("f8")

    logc = np.log10(np.maximum(c, 1))
    sums = {
        "s0": add(c >= 0, np.log10(c + 1.0)),
        "known": add(c > 0),
        "unseen": add(r == 0),
        "a": add(r > CUT, np.log10(np.maximum(r, 1))),
        "b": add((r == 0) & (c > CUT), logc),
    }
    sums |= {f"r{k}": add(r == k) for k in range(1, CUT + 1)}
    sums |= {f"u{k}": add((r == 0) & (c == k)) for k in range(CUT + 1)}
    out = [_row("doc", n, DOC, rid=rids, id=own["ids"], held=sizes % 2 == 0, n_tokens=sizes // 2, **sums)]
    # tokens in unseen pairs wait for the weight of their history
    history, at = np.unique(joined("lost", "u8"), return_inverse=True)
    place = np.zeros(len(seen), "i8")
    place[seen == 0] = at
    mask = r == 0
    lost, m = np.unique(docs[mask] * max(len(history), 1) + np.repeat(place, times)[mask], return_counts=True)
    if len(lost):
        doc, at = np.divmod(lost, len(history))
        out.append(_row("lost", len(lost), DOC, rid=rids[doc], n=m, key=history[at].view("i8")))
    return pa.Table.from_batches(out)


def _histories(rows: pa.Table) -> pa.Table:
    """What was seen after the histories of a part, each once."""
    raw = rows.select(["keys", "history"]).to_pylist()
    key = np.concatenate([plain(row["keys"], "u8") for row in raw])
    table = [plain(row["history"], "f8").reshape(len(HISTORY), -1) for row in raw]
    order = np.argsort(key, kind="stable")
    key, table = key[order], np.concatenate(table, axis=1)[:, order]
    head, _ = _grouped(key)
    table = np.add.reduceat(table, head, axis=1)
    out = _row("hist", 1, DOC, keys=[dense(key[head])], history=[dense(table.reshape(-1))])
    return pa.Table.from_batches([out])


def _gathered(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """What the parts have sent to one place."""
    kind = key[0].as_py()
    if kind == "back":
        return _sums(rows)
    if kind == "hist":
        return _histories(rows)
    return pa.Table.from_batches([_row(kind, len(rows), DOC, counts=rows.column("counts").to_pylist())])


def _weights(d: list[float], e: list[float], tokens: int):
    """Backoff weight and total of every history of a part, as one logarithm."""
    k = np.arange(1, CUT + 1)[:, None]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            key, table = plain(row["keys"], "u8"), plain(row["history"], "f8").reshape(len(HISTORY), -1)
            total = table[0] + (k * table[1 : CUT + 1]).sum(0)
            used = table[0] + (k * np.array(d)[:, None] * table[1 : CUT + 1]).sum(0)
            lower = table[CUT + 1] + (k * np.array(e)[:, None] * table[CUT + 2 :]).sum(0)
            left, rest = 1 - used / (total + 1), 1 - lower / (tokens + 1)
            term = np.log10(left) - np.log10(rest) + np.log10(total + 1)
            for i in range(0, len(key), 50_000):
                some = slice(i, i + 50_000)
                yield pa.record_batch({"key": pa.array(key[some].view("i8")), "term": pa.array(term[some])})

    return work


def discounts(n: list[int]) -> list[float]:
    """Katz's discount of counts 1 to ``CUT`` from the numbers of things seen 1 to CUT + 1 times.

    Where these numbers give none between 0 and 1, half a count is taken off instead.
    """
    out = []
    common = (CUT + 1) * n[CUT] / n[0] if n[0] else 1.0
    for r in range(1, CUT + 1):
        turing = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 0.0
        d = (turing - common) / (1 - common) if common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Tokens are the words of the text in lower case (A-Z) and one end. The model learns from rows
    whose ``crc32(key as text) mod 7`` is not 2. ``base_score`` is the sum of
    ``log10((c + 1) / (N + 1 * (V + 1)))``; ``score`` the Katz model's: a pair seen r times after
    a history of c tokens has ``d(r) r / (c + 1)``, an unseen one the history's backoff weight
    times the word's own ``e(c) c / (N + 1)``, and what these leave is the one unknown word's. The
    1 leaves every history some mass, so no score is infinite. Null text counts as empty: the end
    alone. A null key is learnt from. Repeated rows are scored, and learnt from, each; without
    training rows every word is unknown; an empty table gives no rows. Other columns are ignored.
    Rows are read as often as a task runs, in the order of their files; where a frame has them in
    another order when a lost task runs again, the job fails: stage such a frame first.
    """
    held = F.coalesce(crc32_fold(F.col(key), FOLDS) == HELD_OUT, F.lit(False))
    rows = df.select(
        F.col(key).cast("bigint").alias("id"), (~held).alias("train"), F.col(text).cast("binary").alias("raw")
    )
    tokens, frequent, common = counted_words(rows)
    parts = min(1 << 20, max(LEAST_PARTS, -(-tokens // PART_TOKENS)))
    hot = coded(np.array([word_key(w) for w in frequent], "u8"), common)
    hot_counts = np.array(list(frequent.values()), "i8")
    pairs = rows.mapInArrow(_dense_pairs(_sorter(parts, hot, common)), PAIRS).repartitionById(parts, F.col("part"))
    told = pairs.mapInArrow(_part(parts, hot, hot_counts), OUT)
    summed = staged(told.groupBy("kind", "home").applyInArrow(_gathered, SUMMED), "lm-sums", by=["kind"])

    def kind(name: str, *columns: str) -> DataFrame:
        return summed.filter(F.col("kind") == name).select(*columns)

    width = 2 * (CUT + 1) + 2
    sums = [F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)) for i in range(width)]
    counts = list(kind("cc", "counts").agg(*sums).first())
    for k in range(1, CUT + 2):  # on small tables words seen this seldom may be frequent
        counts[k - 1] += int((hot_counts == k).sum())
    types = counts[CUT + 1] + len(hot)
    total = counts[CUT + 2] + int(hot_counts.sum())
    e, d = discounts(counts[: CUT + 1]), discounts(counts[CUT + 3 :])
    once = [counts[i] * (i + 1) for i in range(CUT)]  # tokens of words seen 1 to CUT times
    unknown = 1 - (total - sum(n * (1 - x) for n, x in zip(once, e, strict=True))) / (total + 1)
    weights = kind("hist", "keys", "history").mapInArrow(_weights(d, e, total), "key bigint, term double")
    lost = kind("lost", "rid", "key", "n").join(weights, "key", "left")
    backed = lost.select("rid", (F.col("n") * F.coalesce("term", F.lit(0.0))).alias("backoff"))
    backed = backed.groupBy("rid").agg(F.sum("backoff").alias("backoff")).hint("merge")
    added = kind("doc", "rid", "id", "n_tokens", "held", *SUMS).join(backed, "rid", "left")
    seen = F.col("a")
    for k in range(1, CUT + 1):
        seen = seen + F.col(f"r{k}") * log10(d[k - 1] * k)
    lower = F.col("b") - F.col("unseen") * log10(total + 1)
    lower = lower + F.col("u0") * (log10(unknown) + log10(total + 1))
    for k in range(1, CUT + 1):
        lower = lower + F.col(f"u{k}") * log10(e[k - 1] * k)
    return added.select(
        F.col("id").alias(key),
        F.col("held").alias("held_out"),
        "n_tokens",
        F.col("known").cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("s0") - F.col("n_tokens") * log10(total + types + 1)).alias("base_score"),
        (seen - F.col("s0") + lower + F.coalesce("backoff", F.lit(0.0))).alias("score"),
    )
