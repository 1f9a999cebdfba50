"""Nearest neighbours by largest inner product: one graph per shard, shard results merged.

Equal vectors are indexed once, with the smallest of their ids, as many as a result can hold. An
index row is a whole shard as flat arrays; shards have at most ``SHARD_ROWS`` vectors. Queries meet
every shard in blocks, so that neither side of a group grows with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.llm import hnsw
from corpuslens.llm.common import staged

SHARD_ROWS = 65_536  # vectors of a shard on average at most
LEAST_SHARDS = 8
BLOCK_ROWS = 32_768  # queries of a block on average
SALTS = 16  # of equal vectors, before their smallest ids are ranked

INDEX = (
    "dim int, shard int, ids binary, starts binary, vectors binary, "
    "levels array<struct<nodes:binary,links:binary>>"
)


def usable(vector: Column) -> Column:
    """Not null, all components finite, not all zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """``(dim, vec, ids)``: every vector once, with its ``most`` smallest ids in order."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))

    def smallest(df: DataFrame, *keys: str) -> DataFrame:
        by = W.partitionBy(*keys).orderBy("id")
        return df.withColumn("_place", F.dense_rank().over(by)).filter(F.col("_place") <= most)

    few = smallest(smallest(salted, "h", "vec", "salt"), "h", "vec")
    return few.groupBy("h", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def _index(key: tuple, table: pa.Table) -> pa.Table:
    vectors = np.array(table.column("vec").combine_chunks().flatten(), "f4").reshape(len(table), -1)
    ids = table.column("ids").combine_chunks()
    levels = hnsw.build(vectors)
    row = {
        "dim": [vectors.shape[1]],
        "shard": [key[1].as_py()],
        "ids": [np.array(ids.flatten(), "<i8").tobytes()],
        "starts": [np.array(ids.offsets, "<i8").tobytes()],
        "vectors": [vectors.tobytes()],
        "levels": [[{"nodes": x.nodes.tobytes(), "links": x.links.tobytes()} for x in levels]],
    }
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    kinds.append(pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())])))
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(row.items(), kinds, strict=True)})


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """One row per shard, staged: ids and vectors in order, and every level's flat arrays."""
    placed = distinct.select(
        F.size("vec").alias("dim"), F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "vec", "ids"
    )
    return staged(placed.groupBy("dim", "shard").applyInArrow(_index, INDEX), "ann-index")


def _searcher(top: int, ef: int):
    def find(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        asked = np.array(queries.column("vec").combine_chunks().flatten(), "f4") if len(queries) else None
        for shard in index.to_pylist() if len(queries) else []:
            dim = shard["dim"]
            vectors = np.frombuffer(shard["vectors"], "f4").reshape(-1, dim)
            ids, starts = np.frombuffer(shard["ids"], "<i8"), np.frombuffer(shard["starts"], "<i8")
            levels = []
            for level in shard["levels"]:
                nodes = np.frombuffer(level["nodes"], "i4")
                levels.append(hnsw.Level(nodes, np.frombuffer(level["links"], "i4").reshape(len(nodes), -1)))
            own = np.array(queries.column("id"))
            number = np.array(queries.column("q"))
            found = hnsw.search(vectors, levels, asked.reshape(-1, dim), ef)
            for at in range(0, len(own), 1024):
                near, q = found[at : at + 1024], asked.reshape(-1, dim)[at : at + 1024].astype("f8")
                row, col = np.nonzero(near >= 0)
                near = near[row, col]
                score = np.einsum("nd,nd->n", q[row], vectors[near].astype("f8"))
                many = starts[near + 1] - starts[near]
                row, score = np.repeat(row, many), np.repeat(score, many)
                step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                vec_id = ids[np.repeat(starts[near], many) + step]
                keep = vec_id != own[at + row]
                row, score, vec_id = row[keep], score[keep], vec_id[keep]
                order = np.lexsort((vec_id, -score, row))
                row, score, vec_id = row[order], score[order], vec_id[order]
                first = np.searchsorted(row, row)
                keep = np.arange(len(row)) - first < top
                out.append((number[at + row[keep]], own[at + row[keep]], vec_id[keep], score[keep]))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.empty(0, "i8")] * 4
        kinds = dict.fromkeys(("q", "query_id", "vec_id"), pa.int64()) | {"score": pa.float64()}
        return pa.table({c: pa.array(p, k) for (c, k), p in zip(kinds.items(), parts, strict=True)})

    return find


def nearest(
    df: DataFrame,
    every: int = 20,
    top: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    least_shards: int = LEAST_SHARDS,
    ef: int = hnsw.EF_SEARCH,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` nearest rows found for every query.

    Queries are the rows whose key is divisible by ``every``; candidates all rows but those with
    the query's key. Nearest is the largest inner product, in double precision over the given
    vectors; ties go to the smaller key. Rows whose vector is null, empty, all zero or holds null
    or non-finite components, and rows with a null key, take no part. Vectors meet only vectors of
    their own length. A key and vector that repeat are one candidate; a repeated query row is
    answered once per row. Other columns are ignored; an empty table gives no rows.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("h", F.xxhash64("vec"))
    distinct = staged(distinct_vectors(rows, top + 1), "ann-vectors")
    queries = rows.filter(F.pmod("id", F.lit(every)) == 0)
    queries = staged(queries.withColumn("q", F.monotonically_increasing_id()), "ann-queries")
    shards = max(least_shards, -(-distinct.count() // shard_rows))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    index = build_index(distinct, shards)
    asked = queries.select(
        F.size("vec").alias("dim"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"),
        "q",
        "id",
        "vec",
    )
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    found = (
        spread.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInArrow(_searcher(top, ef), "q bigint, query_id bigint, vec_id bigint, score double")
    )
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
