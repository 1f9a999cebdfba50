"""Quality rules by compression bands, with the usual counts of words, symbols and repeats.

Each text is compressed with zstandard as a whole and in fixed chunks. A ratio (compressed by plain
bytes) below the limit of its length means repetition, one above it means noise. Texts stay in their
task; an Arrow batch is worked on in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVEL = 3
CHUNK = 4096  # bytes
SLICE = 8 << 20  # bytes of text worked on at once
WINDOW = 8  # words
SYMBOLS = "[#*$%&|<>]"


class Band(NamedTuple):
    """Texts of at least ``size`` bytes compress to a share of ``low`` to ``high``."""

    size: int
    low: float
    high: float


#: Short texts carry the frame's overhead and have few chances to repeat, so limits follow the length.
BANDS = (
    Band(0, 0.0, float("inf")),
    Band(128, 0.30, 1.00),
    Band(512, 0.25, 0.80),
    Band(2048, 0.20, 0.70),
    Band(16384, 0.15, 0.65),
)
BAD_CHUNKS = 25  # percent of chunks outside their band that a text may have


def in_band(size: int, ratio: float, bands: tuple[Band, ...] = BANDS) -> bool:
    band = max((b for b in bands if b.size <= size), key=lambda b: b.size)
    return band.low <= ratio <= band.high


def compressed(data: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """``(ratio, chunks, chunks outside their band, accepted)`` of one text."""
    if not data:
        return 0.0, 0, 0, False

    def ratio(part: bytes | memoryview) -> float:
        return len(squeeze.compress(part)) / len(part)

    whole = ratio(data)
    starts = range(0, len(data), CHUNK) if len(data) > CHUNK else ()
    parts = (memoryview(data)[s : s + CHUNK] for s in starts)
    bad = sum(not in_band(len(p), ratio(p)) for p in parts)
    good = in_band(len(data), whole) and 100 * bad <= BAD_CHUNKS * len(starts)
    return whole, len(starts), bad, good


def in_repeats(words: np.ndarray, owner: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Which words stand in a run of ``width`` words that its text holds twice or more.

    ``words`` are numbers of words, ``owner`` the number of the text of each. Windows meet by a hash
    and are then compared word by word.
    """
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.arange(len(words) - width + 1) if len(words) >= width else np.empty(0, np.int64)
    starts = starts[owner[starts] == owner[starts + width - 1]]
    if not len(starts):
        return covered[:-1] > 0
    mixed = owner[starts].astype(np.uint64)
    for j in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[starts + j].astype(np.uint64)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    hashes = mixed[order]
    same = hashes[1:] == hashes[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    found, runs = starts[order[shared]], hashes[shared]
    if not len(found):
        return covered[:-1] > 0
    first = np.concatenate([[True], runs[1:] != runs[:-1]])
    head = found[np.maximum.accumulate(np.where(first, np.arange(len(found)), 0))]
    unlike = owner[found] != owner[head]
    for j in range(width):
        unlike |= words[found + j] != words[head + j]
    if unlike.any():  # hashes of unequal windows met
        seen: dict[tuple, int] = {}
        keys = [(owner[s], *words[s : s + width]) for s in found.tolist()]
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
        found = found[[seen[key] > 1 for key in keys]]
    np.add.at(covered, found, 1)
    np.subtract.at(covered, found + width, 1)
    return np.cumsum(covered)[:-1] > 0


def _owners(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts and compression of some texts without nulls, one array per column."""
    n = len(texts)

    def per_text(owner: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, weights, minlength=n).astype(np.int64)

    split = pc.ascii_split_whitespace(texts)
    flat, owner = split.flatten(), _owners(split)
    chars = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
    real = chars > 0
    owner, chars = owner[real], chars[real]
    words = flat.filter(pa.array(real)).dictionary_encode().indices.to_numpy(zero_copy_only=False)

    split = pc.split_pattern(texts, "\n")
    lines, line_owner = split.flatten(), _owners(split)
    full = pc.not_equal(pc.ascii_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)
    ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = (line_owner * (len(ids) + 1) + ids)[full]
    once = np.unique(keys) // (len(ids) + 1)

    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    squeezed = [compressed(t.as_buffer().to_pybytes(), squeeze) for t in texts]
    return {
        "n_words": per_text(owner),
        "word_chars": per_text(owner, chars),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": per_text(line_owner[full]) - per_text(once),
        "n_repeat_words": per_text(owner[in_repeats(words, owner)]),
        "n_bytes": pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64),
        "ratio": np.array([x[0] for x in squeezed], dtype=np.float64),
        "n_chunks": np.array([x[1] for x in squeezed], dtype=np.int64),
        "n_bad_chunks": np.array([x[2] for x in squeezed], dtype=np.int64),
        "in_bands": np.array([x[3] for x in squeezed], dtype=bool),
    }


MEASURES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("n_bad_chunks", T.LongType()),
        T.StructField("in_bands", T.BooleanType()),
    ]
)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of runs of about ``SLICE`` bytes, at least one text each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield at, stop - at
        at = stop


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for at, n in slices(texts):
            found = measure(texts.slice(at, n))
            key = batch.column(0).slice(at, n)
            yield pa.RecordBatch.from_arrays(
                [key, *map(pa.array, found.values())], [batch.schema.names[0], *found]
            )


def judge_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, compression and verdict of every text: one row per row of ``df``.

    Returns ``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bytes, ratio,
    n_chunks, n_bad_chunks, in_bands, base_failed, kept)``. Words stand between ASCII white space;
    ``n_repeat_words`` counts words in runs of ``WINDOW`` words found twice or more in the text,
    ``n_dup_lines`` lines with a word that equal an earlier line. ``base_failed`` holds for under 20
    words or over 30 % repeated ones; ``in_bands`` when the whole text's ratio lies in the band of its
    length and at most ``BAD_CHUNKS`` percent of its chunks of ``CHUNK`` bytes (texts longer than one
    chunk) lie outside theirs. ``kept`` needs both. Null text counts as empty: no words, ratio 0, not
    kept. Texts of any length are measured whole. Repeated rows give repeated rows, null keys stay,
    other columns are ignored, an empty table gives no rows.
    """
    frame = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [T.StructField("_key", df.schema[key].dataType), *MEASURES.fields]
    found = frame.mapInArrow(_measured, T.StructType(fields))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select(
        F.col("_key").alias(key),
        *MEASURES.names,
        failed.alias("base_failed"),
        (~failed & F.col("in_bands")).alias("kept"),
    )
