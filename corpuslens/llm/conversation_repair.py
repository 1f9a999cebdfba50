"""Repair of conversations by iterative-deepening A*.

A repaired conversation has the role initials ``(s?(ua)+)?``. Keeping a row is free, giving it the role
that is due costs 3, deleting it 4, inserting the role that is due 3; a truncated row that stays
costs 3 more; blank and repeated rows must go. The search is depth first with edits in ASCII order
(Delete, Insert, Keep, Rerole) under a bound on cost that rises until a path is accepted, so that the
first accepted path is the cheapest and, of those, the ASCII-least.

Conversations may hold any number of rows. Rows without their texts are sorted by range of
conversation and turn, so that a long conversation lies in many tasks, and cut into segments. A
segment that may be a part of a conversation is searched from every state to every state; the
parts are then joined by cost and, among equals, by the order of their edits. The texts are shuffled
once, to be written in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import staged

SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
DUE = (USER, USER, ASSISTANT, USER)  # state after the role that is due in a state
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLE = {USER: "user", ASSISTANT: "assistant"}
TAIL = (0, 2, 1, 0)  # insertions that end a conversation left in a state
LEGAL = {"su", "ua", "au"}
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 60

SEGMENT = 1024  # rows of a conversation searched together
BLOCK = 32  # rows within which the estimate of the remaining cost is exact


class Row(NamedTuple):
    """A row and its ``copies`` identical followers, which must go."""

    initial: str
    must_go: bool
    truncated: bool
    copies: int = 0


def moves(rows: list[Row], i: int, state: int, tail: bool) -> list[tuple[str, int, int, int]]:
    """Edits possible before row ``i``, in ASCII order: ``(letter, next row, next state, cost)``."""
    if i == len(rows):
        return [("I", i, DUE[state], INSERT)] if tail else []
    row = rows[i]
    copies = DELETE * row.copies
    found = [("D", i + 1, state, DELETE + copies), ("I", i, DUE[state], INSERT)]
    if not row.must_go:
        stays = TRUNCATED * row.truncated + copies
        if row.initial in KEEP[state]:
            found.append(("K", i + 1, KEEP[state][row.initial], stays))
        found.append(("R", i + 1, DUE[state], REROLE + stays))
    return found


def estimates(rows: list[Row], last: list[int], tail: bool) -> list[list[int]]:
    """Per row and state a cost that the rest has at least: exact up to the end of the row's block,
    and from there that of the cheapest state. ``last`` holds the costs after the last row."""
    after = list(last)
    out = [after]
    for i in range(len(rows) - 1, -1, -1):
        by_row = [
            min(cost + after[s] for letter, _, s, cost in moves(rows, i, state, tail) if letter != "I")
            for state in STATES
        ]
        once = [INSERT + by_row[DUE[s]] for s in STATES]
        twice = [2 * INSERT + by_row[DUE[DUE[s]]] for s in STATES]
        after = [min(x) for x in zip(by_row, once, twice, strict=True)]
        if i % BLOCK == 0:  # states without a way to the goal stay without
            after = [min(after) if x < NEVER else NEVER for x in after]
        out.append(after)
    return out[::-1]


def search(rows: list[Row], start: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """``(cost, edits)`` from a state to ``goal``, or to the end of a conversation where that is None;
    None if there is no way. Copies of a row are counted in the cost but not written as edits."""
    tail, n = goal is None, len(rows)
    goals = {START, ASSISTANT} if tail else {goal}
    last = [INSERT * t for t in TAIL] if tail else [0 if s == goal else NEVER for s in STATES]
    rest = estimates(rows, last, tail)
    if not n and start in goals:
        return 0, ""
    bound = rest[0][start]
    while bound < NEVER:
        higher = NEVER
        tried: dict[tuple[int, int], int] = {}  # most that was left to spend where a search failed
        edits: list[str] = []
        stack = [(0, iter(moves(rows, 0, start, tail)))]
        while stack:
            spent, todo = stack[-1]
            for letter, i, state, cost in todo:
                total = spent + cost
                if total + rest[i][state] > bound:
                    higher = min(higher, total + rest[i][state])
                elif tried.get((i, state), -1) < bound - total:
                    tried[i, state] = bound - total
                    edits.append(letter)
                    if i == n and state in goals:
                        return total, "".join(edits)
                    stack.append((total, iter(moves(rows, i, state, tail))))
                    break
            else:
                stack.pop()
                if edits:
                    edits.pop()
        bound = higher
    return None


def written(edits: str, rows: list[Row]) -> str:
    """Edits with those of the copies."""
    if not any(r.copies for r in rows):
        return edits
    out, i = [], 0
    for letter in edits:
        out.append(letter)
        if letter != "I":
            out.append("D" * rows[i].copies)
            i += 1
    return "".join(out)


class _Part:
    """Rows of one conversation that follow each other in a task."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None

    def add(self, turn: int | None, initial: str, blank: bool, repeats: bool, cut: bool, n: int) -> None:
        if self.rows and self.rows[-1].initial + initial not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1
        self.n += n
        self.blank += n * blank
        self.duplicate += 0 if blank else n - (not repeats)
        cut = cut and not blank and not repeats
        self.truncated += cut
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        self.rows.append(Row(initial, blank or repeats, cut, n - 1))

    def found(self, whole: bool) -> dict:
        ways = [search(self.rows)] if whole else [search(self.rows, s, t) for s in STATES for t in STATES]
        order = sorted({w[1] for w in ways if w})
        return {
            "whole": whole,
            "blank": self.blank,
            "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": self.illegal,
            "turns": self.turns,
            "first_turn": self.first_turn,
            "last_turn": self.last_turn,
            "first": self.rows[0].initial,
            "last": self.rows[-1].initial,
            "costs": [w[0] if w else None for w in ways],
            "ranks": [order.index(w[1]) if w else None for w in ways],
            "audits": [written(w[1], self.rows) if w else None for w in ways],
        }


FOUND = (
    "part int, seq int, whole boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "turns bigint, first_turn bigint, last_turn bigint, first string, last string, costs array<bigint>, "
    "ranks array<int>, audits array<string>"
)
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
ARROW |= {f"array<{kind}>": pa.list_(arrow) for kind, arrow in ARROW.items()}


def _segments(segment: int):
    """Segments of the conversations of a task, whose rows come in order."""
    fields = [(name, ARROW[kind]) for name, kind in (f.split(" ") for f in FOUND.split(", "))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        schema = pa.schema([])
        out: list[dict] = []
        part, conv, seq, at, begun = _Part(), None, 0, 0, False

        def close(ends: bool) -> None:
            # The first and the last conversation of a task may go on in its neighbours.
            nonlocal part, seq
            out.append({"conv": conv, "part": number, "seq": seq} | part.found(ends and at > 0 and not begun))
            part, seq = _Part(), seq + 1

        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field(0).type), *fields])
            for next_conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part.rows and next_conv != conv:
                    close(True)
                    at, begun = at + 1, False
                elif len(part.rows) >= segment:
                    close(False)
                    begun = True
                conv = next_conv
                part.add(*row)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if part.rows:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return cut


def _chained(segments: pa.Table) -> pa.Table:
    """The ways through the segments of one conversation that are cheapest together."""
    rows = sorted(segments.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    best = [[INSERT * t for t in TAIL]]
    for r in reversed(rows):
        ways = [[(c, t) for t, c in enumerate(r["costs"][4 * s : 4 * s + 4]) if c is not None] for s in STATES]
        best.append([min(c + best[-1][t] for c, t in ways[s]) for s in STATES])
    best.reverse()
    out, state, turn, last = [], START, None, None
    for k, r in enumerate(rows):
        costs, ranks = r["costs"][4 * state : 4 * state + 4], r["ranks"][4 * state : 4 * state + 4]
        _, end = min((ranks[t], t) for t, c in enumerate(costs) if c is not None and c + best[k + 1][t] == best[k][state])
        out.append(
            {
                "part": r["part"],
                "seq": r["seq"],
                "pick": 4 * state + end,
                "tail": TAIL[end] if k == len(rows) - 1 else 0,
                "joins_illegal": int(last is not None and last + r["first"] not in LEGAL),
                "same_turn": int(turn is not None and turn == r["first_turn"]),
            }
        )
        state, last, turn = end, r["last"], turn if r["last_turn"] is None else r["last_turn"]
    kinds = [pa.int32()] * 4 + [pa.int64()] * 2
    return pa.Table.from_pylist(out, pa.schema(list(zip(out[0], kinds, strict=True))))


def _identity(role: Column, text: Column) -> Column:
    """What two rows share when role and text agree."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _plain(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    return rows.withColumn("same", _identity(F.col("role"), F.col("text")))


ORDER = ["conv", "turn", "role", "same"]  # nulls first


def repair_conversations(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """Faults and cheapest edits: one row per conversation that has rows.

    Returns ``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)``. Rows come by turn, nulls
    first; rows of one turn by role and then by a digest of role and text, so that equal rows stand
    together. Null roles and texts count as one space. A row's first fault counts: blank (white
    space only), duplicate (role and text seen earlier in the conversation), truncated (no ``.!?`` as
    last character that is not white space). ``gaps`` are turns missing between the least and the
    greatest; ``illegal`` are neighbours, as they came, whose role initials are not ``su``, ``ua`` or ``au``; a
    role without characters has no legal initial. ``audit`` has one letter per edit, those of deleted
    rows included. A null conversation id is a conversation of its own. Other columns are ignored;
    an empty table gives no rows.
    """
    rows = _plain(df, conv, turn, role, text)
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    light = rows.groupBy(
        "conv",
        "turn",
        "role",
        "same",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    ).agg(F.count("*").alias("n"))
    # min() over (has a turn, turn): nulls come first.
    firsts = light.groupBy("conv", "same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    firsts = firsts.select(F.col("conv").alias("conv1"), F.col("same").alias("same1"), "first")
    same = light["conv"].eqNullSafe(firsts["conv1"]) & (light["same"] == firsts["same1"])
    repeats = ~F.col("first.turn").eqNullSafe(F.col("turn"))
    light = light.join(firsts.hint("merge"), same).withColumn("repeats", repeats)
    light = staged(light.drop("conv1", "same1", "first"), "repair-rows")

    ordered = light.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ordered = ordered.select("conv", "turn", "initial", "blank", "repeats", "cut", "n")
    schema = T.StructType([rows.schema["conv"], *T.StructType.fromDDL(FOUND).fields])
    cut = staged(ordered.mapInArrow(_segments(segment), schema), "repair-segments")
    parts = cut.filter(~F.col("whole")).select(
        "conv", "part", "seq", "costs", "ranks", "first", "last", "first_turn", "last_turn"
    )
    chain = parts.groupBy("conv").applyInArrow(
        _chained, "part int, seq int, pick int, tail int, joins_illegal bigint, same_turn bigint"
    )
    found = cut.join(chain, ["part", "seq"], "left").fillna(0, ["pick", "tail", "joins_illegal", "same_turn"])
    audit = F.concat(F.get("audits", F.col("pick")), F.repeat(F.lit("I"), F.col("tail")))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", audit.alias("a")))), lambda x: x["a"])
    gaps = F.max("last_turn") - F.min("first_turn") + 1 - F.sum(F.col("turns") - F.col("same_turn"))
    return found.groupBy(F.col("conv").alias(conv)).agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"),
        F.sum("blank").alias("blank"),
        F.sum("duplicate").alias("duplicate"),
        F.sum("truncated").alias("truncated"),
        F.sum(F.col("illegal") + F.col("joins_illegal")).alias("illegal"),
        F.sum(F.get("costs", F.col("pick")) + INSERT * F.col("tail")).cast("bigint").alias("cost"),
        F.array_join(in_order, "").alias("audit"),
    )


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows. A conversation's audit comes first and its rows follow in order."""
    names: list[str] = []
    conv, audit, at, state, place = None, "", 0, START, 0
    convs, out = [], []

    def emit(letter: str, role: str, text: str) -> None:
        nonlocal place
        convs.append(conv)
        out.append((place, letter, role, text))
        place += 1

    def insert_due() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = DUE[state]
            emit("I", ROLE[state], "")
            at += 1

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
        arrays = [pa.array(convs, kind), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        convs.clear()
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names)

    kind = pa.null()
    for batch in batches:
        kind = batch.column(0).type
        names = [batch.schema.names[0], "place", "edit", "role", "text"]
        for next_conv, plan, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if plan is not None:
                insert_due()
                conv, audit, at, state, place = next_conv, plan, 0, START, 0
                continue
            insert_due()
            letter = audit[at]
            at += 1
            if letter == "K":
                state = KEEP[state][role[:1]]
                emit(letter, role, text)
            elif letter == "R":
                state = DUE[state]
                emit(letter, ROLE[state], text)
        yield flush(kind)
    if names:
        insert_due()
        yield flush(kind)


def repaired_rows(
    df: DataFrame,
    report: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The conversations after the edits of ``report``: ``(conv, place, edit, role, text)``, the rows of
    a conversation in one task and in order. Only texts on their way are held in memory."""
    rows = _plain(df, conv, turn, role, text).withColumn("audit", F.lit(None).cast("string"))
    heads = report.select(
        F.col(conv).alias("conv"),
        F.lit(None).cast("bigint").alias("turn"),
        *(F.lit(None).cast("string").alias(c) for c in ("role", "text")),
        F.lit(None).cast("binary").alias("same"),
        "audit",
    )
    both = rows.unionByName(heads).repartition("conv")
    first, *others = ORDER
    both = both.sortWithinPartitions(first, F.col("audit").isNull(), *others).select("conv", "audit", "role", "text")
    fields = [rows.schema["conv"]]
    fields += T.StructType.fromDDL("place bigint, edit string, role string, text string").fields
    return both.mapInArrow(_applied, T.StructType(fields)).withColumnRenamed("conv", conv)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, conv, names = None, None, []
    for batch in batches:
        done = []
        names = batch.schema.names[:1]
        kind = batch.column(0).type
        for next_conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place == 0:
                if digest:
                    done.append((conv, digest.hexdigest()))
                digest, conv = hashlib.sha256(), next_conv
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in done], kind), pa.array([h for _, h in done], pa.string())], [*names, "sha256"]
        )
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], [*names, "sha256"])


def digests(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """SHA-256 of every conversation's ``role:text`` lines; the rows must come as :func:`repaired_rows`
    returns them. A digest has one order, so a conversation is read by one task, as a stream."""
    rows = repaired.select(F.col(conv).alias("conv"), "place", "role", "text")
    fields = [T.StructField("conv", repaired.schema[conv].dataType), T.StructField("sha256", T.StringType())]
    return rows.mapInArrow(_hashed, T.StructType(fields)).withColumnRenamed("conv", conv)
