"""Path trees as flat node tables.

Entries are ``(tree_id, seq, path, is_dir, size, mode)``; nodes are
``(tree_id, path, parent, name, depth, is_dir, size, mode, seq)``. A tree, and a directory of it, may
hold most of all rows, so no step brings one together: nodes are sorted by range of their keys, and
what partitions must know of each other is one row per tree and partition. Caps are for previews,
which ask for them. A tree that is one value of a row is drawn inside the row, see
:mod:`corpuslens.functions.trees`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import Window as W

from corpuslens.functions.trees import drawn_line, is_noise, path_parts
from corpuslens.limits import DEFAULTS
from corpuslens.operators.ranking import first_per_group
from corpuslens.plans.storage import work_dir


def drop_noise(entries: DataFrame, comic: bool = False) -> DataFrame:
    """Entries without archiver noise."""
    return entries.filter(~is_noise(F.col("path"), comic))


def cap_entries(entries: DataFrame, max_entries: int = DEFAULTS.archive_entries) -> DataFrame:
    """First ``max_entries`` entries of every tree by ``seq``."""
    return first_per_group(entries, ["tree_id"], ["seq"], max_entries, "_rank").drop("_rank")


def build_nodes(entries: DataFrame, max_entries: int | None = None) -> DataFrame:
    """Nodes of every tree, implied directories included; of its first ``max_entries`` if given.

    Per node the last touch decides ``is_dir`` (an entry below it makes it a directory); size and
    mode are the last ones stated for the path itself.
    """
    kept = cap_entries(entries, max_entries) if max_entries else entries
    parts = kept.select(
        "tree_id", "seq", "is_dir", "size", "mode", path_parts(F.col("path")).alias("parts")
    )
    touched = parts.filter(F.size("parts") > 0).select(
        "*", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth")
    )
    leaf = F.col("depth") == F.size("parts")
    touches = touched.select(
        "tree_id",
        F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"),
        "depth",
        "seq",
        (~leaf | F.col("is_dir")).alias("is_dir"),
        F.when(leaf, F.col("size")).alias("size"),
        F.when(leaf, F.col("mode")).alias("mode"),
    )
    stated_size = F.when(F.col("size").isNotNull(), F.col("seq"))
    stated_mode = F.when(F.col("mode").isNotNull(), F.col("seq"))
    nodes = touches.groupBy("tree_id", "path", "depth").agg(
        F.max_by("is_dir", "seq").alias("is_dir"),
        F.max_by("size", stated_size).alias("size"),
        F.max_by("mode", stated_mode).alias("mode"),
        F.min("seq").alias("seq"),
    )
    return nodes.select(
        "tree_id",
        "path",
        F.regexp_replace("path", r"/?[^/]*\z", "").alias("parent"),
        F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"),
        "depth",
        "is_dir",
        "size",
        "mode",
        "seq",
    )


def list_limit(
    entries: DataFrame,
    max_depth: int = DEFAULTS.dir_depth,
    max_entries: int = DEFAULTS.dir_entries,
    hidden: bool = False,
) -> DataFrame:
    """Directory listing as entries: directories first, then names (case-sensitive), preorder.

    Paths with a hidden part go, and so do entries deeper than ``max_depth`` (counted from 0); then
    the first ``max_entries`` of every tree stay. Directories that are only implied by a path below
    them are listed too. ``seq`` is the place in the listing.
    """
    parts = entries.select("tree_id", "is_dir", "size", path_parts(F.col("path")).alias("parts"))
    if not hidden:
        dotted = F.exists("parts", lambda p: F.startswith(p, F.lit(".")))
        # A hidden file does not hide the directories above it.
        first = F.array_position(F.transform("parts", lambda p: F.startswith(p, F.lit("."))), True)
        parts = parts.withColumn(
            "visible", F.when(dotted, first - 1).otherwise(F.size("parts")).cast("int")
        )
    else:
        parts = parts.withColumn("visible", F.size("parts"))
    reach = F.least(F.col("visible"), F.lit(max_depth + 1))
    listed = parts.filter(reach > 0).select(
        "*", F.explode(F.sequence(F.lit(1), reach)).alias("level")
    )
    leaf = F.col("level") == F.size("parts")
    touches = listed.select(
        "tree_id",
        F.slice("parts", F.lit(1), F.col("level")).alias("parts"),
        (~leaf | F.col("is_dir")).alias("is_dir"),
        F.when(leaf & ~F.col("is_dir"), F.col("size")).alias("size"),
    )
    nodes = touches.groupBy("tree_id", "parts").agg(
        F.max("is_dir").alias("is_dir"), F.max("size").alias("size")
    )
    last = F.size("parts") - 1
    key = F.transform(
        "parts",
        lambda p, i: F.struct(
            F.when((i < last) | F.col("is_dir"), 0).otherwise(1).alias("f"), p.alias("n")
        ),
    )
    ranked = first_per_group(
        nodes.withColumn("_key", key), ["tree_id"], ["_key"], max_entries, "seq"
    )
    return ranked.select(
        "tree_id",
        "seq",
        F.array_join("parts", "/").alias("path"),
        "is_dir",
        F.when(~F.col("is_dir"), F.col("size")).alias("size"),
        F.when(F.col("is_dir"), "drwxr-xr-x").otherwise("-rw-r--r--").alias("mode"),
    )


def _sort_keys(nodes: DataFrame) -> DataFrame:
    """Nodes with ``_key``: per level whether it is a file, the lower-cased name, and the place among
    siblings that differ from it in case alone. In order of keys, nodes stand in preorder.

    Only siblings of one name meet in a window. What is no plain directory and has nodes below (a second
    place, or a file in whose place a directory stood) is rare; it reaches the nodes below by a join,
    which adaptive execution leaves out when there is none.
    """
    is_file = F.when(F.col("is_dir"), 0).otherwise(1)
    alike = W.partitionBy("tree_id", "parent", "_f", F.lower("name")).orderBy("seq", "name")
    named = nodes.withColumn("_f", is_file).withColumn("_t", F.row_number().over(alike))
    above = nodes.select("tree_id", F.col("parent").alias("path")).distinct()
    odd = named.filter("_t > 1 OR _f = 1").join(above, ["tree_id", "path"], "left_semi")
    odd = odd.select("tree_id", F.col("path").alias("_above"), F.struct("_f", "_t").alias("_place"))
    parts = F.split("path", "/", -1)
    lineage = nodes.filter("depth > 1").select(
        "tree_id", "path", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("_n")
    )
    lineage = lineage.withColumn("_above", F.array_join(F.slice(parts, F.lit(1), F.col("_n")), "/"))
    places = (
        lineage.join(odd, ["tree_id", "_above"])
        .groupBy("tree_id", "path")
        .agg(F.map_from_entries(F.collect_list(F.struct("_n", "_place"))).alias("_places"))
    )
    plain = F.struct(F.lit(0).alias("_f"), F.lit(1).alias("_t"))
    own = F.struct("_f", "_t")

    def level(name: Column, i: Column) -> Column:
        place = F.coalesce(F.try_element_at("_places", (i + 1).cast("int")), plain)
        place = F.when(i + 1 == F.col("depth"), own).otherwise(place)
        return F.struct(place["_f"].alias("f"), name.alias("n"), place["_t"].alias("t"))

    keyed = named.join(places, ["tree_id", "path"], "left")
    key = F.transform(F.split(F.lower("path"), "/", -1), level)
    return keyed.withColumn("_key", key).drop("_places", "_f", "_t")


def _scan_backward() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to rows in descending preorder their partition, their number from the end in tree and
    partition, and per level whether the ancestor there is the last of its siblings: ``1``, ``0``, or
    ``?`` where rows of later partitions decide. Nested, so that it is shipped by value."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tree, begun, number, levels, beyond = None, False, 0, "", "?"
        for batch in batches:
            numbers, lasts = [], []
            trees = batch.column("tree_id").to_pylist()
            for next_tree, depth in zip(trees, batch.column("depth").to_pylist(), strict=True):
                if not begun or next_tree != tree:
                    tree, begun, number, levels, beyond = next_tree, True, 0, "", "?"
                last = levels[:depth].ljust(depth, beyond)
                numbers.append(number)
                lasts.append(last)
                number, levels, beyond = number + 1, last[:-1] + "0", "1"
            added = [pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64()), pa.array(lasts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], [*batch.schema.names, "_part", "_number", "_lasts"]
            )

    return scan


def _decided(lasts: Column, later: Column) -> Column:
    """``lasts`` with what later partitions say in place of its leading question marks."""
    open_levels = F.length(lasts) - F.length(F.replace(lasts, F.lit("?"), F.lit("")))
    return F.concat(
        F.rpad(F.substr(later, F.lit(1), open_levels), open_levels, F.lit("1")),
        F.substr(lasts, open_levels + 1),
    )


def _placed(nodes: DataFrame) -> DataFrame:
    """Nodes with ``pos``, their place in preorder from 1, and ``lasts``, a ``1`` or ``0`` per level.

    Nodes are sorted by range of tree and key, so that a tree, or a directory, lies in as many tasks
    as it needs; every task scans its nodes backwards. A row per tree and partition then says how
    many nodes come later and which levels go on there.
    """
    spark = nodes.sparkSession
    keyed = _sort_keys(nodes)
    ordered = keyed.repartitionByRange("tree_id", "_key").sortWithinPartitions(
        F.desc("tree_id"), F.desc("_key")
    )
    ordered = ordered.drop("_key")
    schema = ST.StructType([*ordered.schema.fields, *ST.StructType.fromDDL(
        "_part int, _number bigint, _lasts string"
    ).fields])
    path = work_dir(spark, "preorder")
    ordered.mapInArrow(_scan_backward(), schema).write.parquet(path)
    scanned = spark.read.schema(schema).parquet(path)

    levels = F.concat(F.expr("substr(_lasts, 1, depth - 1)"), F.lit("0"))
    parts = scanned.groupBy("tree_id", "_part").agg(
        F.count(F.lit(1)).alias("n"), F.max_by(levels, F.col("_number")).alias("levels")
    )
    start = F.struct(
        F.lit("").alias("later"),
        F.lit(0).cast("bigint").alias("after"),
        F.array().cast("array<struct<_part:int,_later:string,_after:bigint>>").alias("out"),
    )

    def carry(state: Column, part: Column) -> Column:
        here = F.struct(
            part["_part"].alias("_part"), state["later"].alias("_later"), state["after"].alias("_after")
        )
        return F.struct(
            _decided(part["levels"], state["later"]).alias("later"),
            (state["after"] + part["n"]).alias("after"),
            F.concat(state["out"], F.array(here)).alias("out"),
        )

    from_the_end = F.sort_array(F.collect_list(F.struct("_part", "n", "levels")), asc=False)
    carried = parts.groupBy("tree_id").agg(F.aggregate(from_the_end, start, carry).alias("c"))
    carried = carried.select(
        F.col("tree_id").alias("_tree"), F.col("c.after").alias("_total"), F.inline("c.out")
    ).withColumnRenamed("_part", "_of")
    same = scanned["tree_id"].eqNullSafe(carried["_tree"]) & (scanned["_part"] == carried["_of"])
    return scanned.join(carried, same).select(
        *nodes.columns,
        (F.col("_total") - F.col("_after") - F.col("_number")).alias("pos"),
        _decided(F.col("_lasts"), F.col("_later")).alias("lasts"),
    )


def preorder(nodes: DataFrame) -> DataFrame:
    """Nodes with ``pos``: directories first, then lower-cased name, ties by first ``seq``."""
    return _placed(nodes).drop("lasts")


def render_tree(nodes: DataFrame, icons: bool = False) -> DataFrame:
    """``(tree_id, pos, path, line)``: one drawn line per node."""
    node = F.struct("name", "is_dir", "size", "mode")
    return _placed(nodes).select(
        "tree_id", "pos", "path", drawn_line(F.col("lasts"), node, icons).alias("line")
    )


def tree_text(nodes: DataFrame, icons: bool = False) -> DataFrame:
    """``(tree_id, text)``: the drawn tree as one text, a value as long as the tree; previews cap
    their entries."""
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return (
        render_tree(nodes, icons)
        .groupBy("tree_id")
        .agg(
            F.array_join(F.transform(lines, lambda r: F.concat(r["line"], F.lit("\n"))), "").alias(
                "text"
            )
        )
    )


def count_nodes(nodes: DataFrame) -> DataFrame:
    """``(tree_id, n_nodes)``, the root included."""
    return nodes.groupBy("tree_id").agg((F.count(F.lit(1)) + 1).alias("n_nodes"))
