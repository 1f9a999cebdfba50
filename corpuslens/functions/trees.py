"""Trees that are one value of a row: an array of entries becomes a drawn text, inside the row.

Entries are ``array<struct<seq, path, is_dir, size, mode>>``. Sorted by path, the nodes of a tree stand
next to what they share; so every step compares neighbours only, forwards or backwards, and the
plan has no join and no shuffle, which streams need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import BLOCK, first_of, let

ENTRIES = "array<struct<seq:bigint,path:string,is_dir:boolean,size:bigint,mode:string>>"
_TOUCH = "struct<parts:array<string>,seq:bigint,is_dir:boolean,size:bigint,mode:string>"
_KEY = "array<struct<f:int,n:string,s:bigint>>"


def path_parts(path: Column) -> Column:
    """Components of a path, empty ones dropped."""
    return F.filter(F.split(path, "/", -1), lambda p: p != "")


def is_noise(path: Column, comic: bool = False) -> Column:
    """Files that archivers add: resource forks, folder settings, pax headers.

    Comic archives have no rule for pax headers.
    """
    base = F.regexp_extract(path, r"([^/]*)\z", 1)
    noise = (
        F.startswith(base, F.lit("._"))
        | (base == ".DS_Store")
        | F.rlike(path, F.lit(r"(?:\A|/)__MACOSX/"))
    )
    if not comic:
        noise = noise | (base == "PaxHeader") | F.rlike(path, F.lit(r"(?:\A|/)PaxHeader/"))
    return noise


def scan(values: Column, kind: str, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """All states of a fold over an array, in order; ``kind`` is the type of a state.

    States are gathered in blocks of ``BLOCK``, so that no growing array is copied once per element.
    """
    none, no_blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, value: Column) -> Column:
        return let(
            step(acc["s"], value),
            lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out")),
        )

    def block(acc: Column, part: Column) -> Column:
        inner = F.struct(acc["s"].alias("s"), none.alias("out"))
        return let(
            F.aggregate(part, inner, one),
            lambda done: F.struct(
                done["s"].alias("s"), F.concat(acc["out"], F.array(done["out"])).alias("out")
            ),
        )

    def blocks(all_values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.size(all_values) / F.lit(BLOCK)).cast("int"))
        return F.transform(starts, lambda b: F.slice(all_values, b * BLOCK + 1, BLOCK))

    begin = F.struct(start.cast(kind).alias("s"), no_blocks.alias("out"))
    return F.flatten(F.aggregate(let(values, blocks), begin, block, lambda acc: acc["out"]))


def _last_of_path(states: Column) -> Column:
    """Of neighbours with one path the last."""
    return let(
        states,
        lambda all_states: F.filter(
            all_states,
            lambda s, i: ~F.coalesce(F.get(all_states, i + 1)["parts"] == s["parts"], F.lit(False)),
        ),
    )


def _touches(entries: Column) -> Column:
    """Every entry once for its path and each path above, by path."""

    def touches(e: Column) -> Column:
        def each(parts: Column) -> Column:
            levels = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(
                F.array().cast("array<int>")
            )
            return F.transform(
                levels,
                lambda d: F.struct(
                    F.slice(parts, F.lit(1), d).alias("parts"),
                    e["seq"].cast("bigint").alias("seq"),
                    ((d < F.size(parts)) | e["is_dir"]).alias("is_dir"),
                    F.when(d == F.size(parts), e["size"]).cast("bigint").alias("size"),
                    F.when(d == F.size(parts), e["mode"]).alias("mode"),
                ),
            )

        return let(path_parts(e["path"]), each)

    return F.array_sort(F.flatten(F.transform(entries, touches)))


def _merged(touches: Column) -> Column:
    """One struct per path, implied directories included, by path: the last touch decides ``is_dir``,
    ``size`` and ``mode`` are the last ones stated for the path itself, ``seq`` is the first."""

    def merge(s: Column, t: Column) -> Column:
        same = F.coalesce(s["parts"] == t["parts"], F.lit(False))
        return F.struct(
            t["parts"].alias("parts"),
            F.when(same, s["seq"]).otherwise(t["seq"]).alias("seq"),
            t["is_dir"].alias("is_dir"),
            F.coalesce(t["size"], F.when(same, s["size"])).alias("size"),
            F.coalesce(t["mode"], F.when(same, s["mode"])).alias("mode"),
        )

    return _last_of_path(scan(touches, _TOUCH, F.lit(None), merge))


def _in_preorder(nodes: Column, name: Callable[[Column], Column], ties: bool) -> Column:
    """Nodes by the keys of their ancestors and their own: directories first, then ``name``, then, with
    ``ties``, the first ``seq``. By path, a node's ancestors head the chain of the node before it."""

    def chain(s: Column, node: Column) -> Column:
        own = F.struct(
            F.when(node["is_dir"], 0).otherwise(1).alias("f"),
            name(F.element_at(node["parts"], -1)).alias("n"),
            (node["seq"] if ties else F.lit(0)).cast("bigint").alias("s"),
        )
        above = F.slice(F.coalesce(s["key"], F.array().cast(_KEY)), F.lit(1), F.size(node["parts"]) - 1)
        return F.struct(F.concat(above, F.array(own)).alias("key"), node.alias("node"))

    keyed = scan(nodes, f"struct<key:{_KEY},node:{_TOUCH}>", F.lit(None), chain)
    return F.transform(F.array_sort(keyed), lambda k: k["node"])


def _lasts(nodes: Column) -> Column:
    """Per node in preorder a text with a character per level: ``1`` where the ancestor there is the
    last of its siblings, else ``0``. Going backwards, a node's level is open for those before it."""

    def step(after: Column, node: Column) -> Column:
        levels = F.concat(F.substr(after, F.lit(1), F.length(after) - 1), F.lit("0"))
        levels = F.when(after == "", "").otherwise(levels)
        return F.rpad(levels, F.size(node["parts"]), F.lit("1"))

    return F.reverse(scan(F.reverse(nodes), "string", F.lit(""), step))


def drawn_line(lasts: Column, node: Column, icons: bool = False) -> Column:
    """The line of a node (a struct with ``name``, ``is_dir``, ``size`` and ``mode``)."""
    bars = F.substr(lasts, F.lit(1), F.length(lasts) - 1)
    bars = F.replace(F.replace(bars, F.lit("1"), F.lit("    ")), F.lit("0"), F.lit("│   "))
    icon = F.when(node["is_dir"], "📁 ").otherwise("📄 ") if icons else F.lit("")
    size = F.concat(F.lit(" ("), node["size"].cast("string"), F.lit(" B)"))
    return F.concat(
        F.lit("    "),
        bars,
        F.when(F.endswith(lasts, F.lit("1")), "└── ").otherwise("├── "),
        icon,
        node["name"],
        F.coalesce(size, F.lit("")),
        F.coalesce(F.concat(F.lit(" "), node["mode"]), F.lit("")),
    )


def _steps(df: DataFrame, value: Column, steps: Sequence[Callable[[Column], Column]], out: str) -> DataFrame:
    """``value`` through some functions, one projection each: nested in one expression they would be
    analysed once per level of nesting. Null stays null."""
    name = f"__{out}"
    df = df.withColumn(name, value)
    for step in steps:
        df = df.withColumn(name, F.when(F.col(name).isNotNull(), step(F.col(name))))
    return df.withColumn(out, F.col(name)).drop(name)


def with_tree_text(df: DataFrame, entries: Column, out: str, icons: bool = False) -> DataFrame:
    """``df`` with the drawn tree of an array of entries, a line per node; null for null. Rows stay
    where they are."""

    def lines(placed: Column) -> Column:
        drawn = F.zip_with(
            placed["nodes"],
            placed["lasts"],
            lambda node, lasts: F.concat(
                drawn_line(
                    lasts,
                    F.struct(
                        F.element_at(node["parts"], -1).alias("name"),
                        node["is_dir"].alias("is_dir"),
                        node["size"].alias("size"),
                        node["mode"].alias("mode"),
                    ),
                    icons,
                ),
                F.lit("\n"),
            ),
        )
        return F.array_join(drawn, "")

    steps = (
        _touches,
        _merged,
        lambda nodes: _in_preorder(nodes, F.lower, True),
        lambda nodes: F.struct(nodes.alias("nodes"), _lasts(nodes).alias("lasts")),
        lines,
    )
    return _steps(df, entries, steps, out)


def with_listing(df: DataFrame, entries: Column, out: str, max_depth: int, max_entries: int = 0) -> DataFrame:
    """``df`` with the entries of a directory as they are listed: nothing hidden, down to ``max_depth``
    (counted from 0), directories first and then by name, in preorder, the first ``max_entries``
    (0: all)."""

    def shown(e: Column) -> Column:
        def cut(parts: Column) -> Column:
            dotted = F.array_position(F.transform(parts, lambda p: F.startswith(p, F.lit("."))), True)
            visible = F.when(dotted > 0, dotted - 1).otherwise(F.size(parts))
            reach = F.least(visible, F.lit(max_depth + 1)).cast("int")
            whole = reach == F.size(parts)
            return F.struct(
                F.lit(0).cast("bigint").alias("seq"),
                F.array_join(F.slice(parts, F.lit(1), reach), "/").alias("path"),
                (~whole | e["is_dir"]).alias("is_dir"),
                F.when(whole & ~e["is_dir"], e["size"]).cast("bigint").alias("size"),
                F.lit(None).cast("string").alias("mode"),
            )

        return let(path_parts(e["path"]), cut)

    def numbered(nodes: Column) -> Column:
        return F.transform(
            nodes,
            lambda node, i: F.struct(
                (i + 1).cast("bigint").alias("seq"),
                F.array_join(node["parts"], "/").alias("path"),
                node["is_dir"].alias("is_dir"),
                F.when(~node["is_dir"], node["size"]).alias("size"),
                F.when(node["is_dir"], "drwxr-xr-x").otherwise("-rw-r--r--").alias("mode"),
            ),
        )

    steps = (
        lambda all_entries: F.transform(all_entries, shown),
        _touches,
        _merged,
        lambda nodes: first_of(_in_preorder(nodes, lambda name: name, False), max_entries),
        numbered,
    )
    return _steps(df, entries, steps, out)
