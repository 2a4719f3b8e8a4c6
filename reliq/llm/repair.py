"""Repair of conversation structure: the cheapest edits that make the roles read (s?(ua)+)?, by divide and conquer.

Rows of a conversation are ordered by turn (nulls first), then role and text. Each row's first fault counts: blank, duplicate (role and
text seen before), truncated. Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (a must for blank and duplicate rows), Insert an
empty turn 2; a truncated row that stays costs 1 more. The audit names the edits in order by their initials; of the cheapest audits
the ASCII-least is taken.

Roles run through four states: nothing yet, behind system, behind user, behind assistant. A stretch of rows is known by a four by four
matrix of costs from state to state, with the order of the least audits from each state. As in Hirschberg's method, a vector of costs
goes forward from the start to the middle row, one goes backward from the end, and they meet there in the crossing state that is
cheapest and, among these, has the least audit so far; both halves are then solved alike, in linear space. An audit of the same rows is
never the beginning of another (both end in a row's edit), so the order of audits up to a row decides the order of the whole. Vectors
up to a constant are few: a step of a row is looked up once it was computed. Inserting directly before a deletion is left out: after it
costs the same and reads less.

On Spark: rows, reduced to keys and a class, are dealt out by range in conversation order and cut into blocks of ``BLOCK`` rows, so
that a conversation of any length is spread over tasks. Blocks meet as matrices: the same divide and conquer over the blocks of a
conversation gives each its entry and exit state, then all blocks are solved apart. Equal rows with one turn travel as one with a
count. The audit, and ``digests``, which must read a repaired conversation from start to end, are the only results per conversation
that grow with it; digests are made in a stream over sorted rows, not from gathered groups.

Defined cases: null roles and texts read as one blank; rows with a null id are one conversation; null turns come first and are no
part of gaps; repeated rows are duplicates of the first; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliq.llm.store import stored

#: Rows of a block.
BLOCK = 4096
#: Characters that count as white space, and those that end a text.
SPACES, ENDS = " \t\n\x0b\f\r", ".!?"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Cost of a truncated row that stays.
CUT = 1
NEVER = 1 << 60
#: States: nothing yet, behind system, behind user, behind assistant; conversations end in the first or last.
STATES = range(4)
#: Where the next turn leads, by its role's initial.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an insertion or a new role has in a state, and the state behind it.
FILLED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Edits at the end that complete a conversation, by state.
TAIL = ("", "II", "I", "")
#: Classes of rows: the role's initial (0 none of the others, 1 s, 2 u, 3 a), plus 4 if truncated; rows that must go from 8 on.
INITIALS, GOES, BLANK, DUPLICATE = ("", "s", "u", "a"), 8, 8, 9
#: Initials of roles that may follow each other.
LEGAL = {"su", "ua", "au"}


class Matrix(NamedTuple):
    """Costs from state to state, and for each start the places of the least audits in their order."""

    cost: tuple[tuple[int, ...], ...]
    order: tuple[tuple[int, ...], ...]


class Vector(NamedTuple):
    """Costs of the states, less the least of them, and the order of their audits."""

    cost: tuple[int, ...]
    order: tuple[int, ...]


def _edits(kind: int, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, edits, next state) of one row in a state, at most one insertion in front."""
    yield DELETE, "D", state
    if kind >= GOES:
        return
    own = CUT if kind & 4 else 0
    for cost, edits, at in ((0, "", state), (INSERT, "I", FILLED[state][1])):
        to = NEXT[at].get(INITIALS[kind & 3])
        if to is not None:
            yield cost + KEEP + own, edits + "K", to
        yield cost + REROLE + own, edits + "R", FILLED[at][1]


@cache
def best_edits(kind: int, state: int) -> tuple[tuple[int, str] | None, ...]:
    """The least (cost, edits) of one row from a state to every state."""
    found: list[tuple[int, str] | None] = [None] * 4
    for cost, edits, to in _edits(kind, state):
        if found[to] is None or (cost, edits) < found[to]:
            found[to] = cost, edits
    return tuple(found)


@cache
def row_matrix(kind: int) -> Matrix:
    made = [best_edits(kind, s) for s in STATES]
    places = [sorted(e[1] for e in row if e) for row in made]
    return Matrix(tuple(tuple(e[0] if e else NEVER for e in row) for row in made),
                  tuple(tuple(places[s].index(e[1]) if e else 4 for e in row) for s, row in enumerate(made)))


def start(state: int) -> Vector:
    return Vector(tuple(0 if s == state else NEVER for s in STATES), (0, 0, 0, 0))


@cache
def _least(cost: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(cost)
    return tuple(c - low if c < NEVER else NEVER for c in cost), low


def forward(vector: Vector, matrix: Matrix) -> tuple[Vector, int]:
    """The vector behind a stretch of rows, and what was taken off its costs."""
    ways = [min((vector.cost[s] + matrix.cost[s][t], vector.order[s], matrix.order[s][t]) for s in STATES if vector.cost[s] < NEVER) for t in STATES]
    places = sorted({w[1:] for w in ways if w[0] < NEVER})
    cost, low = _least(tuple(min(w[0], NEVER) for w in ways))
    return Vector(cost, tuple(places.index(w[1:]) if w[0] < NEVER else 4 for w in ways)), low


def backward(cost: tuple[int, ...], matrix: Matrix) -> tuple[int, ...]:
    """Costs from the states before a stretch of rows to the end, less the least, given those behind it."""
    return _least(tuple(min(NEVER, *(matrix.cost[s][t] + cost[t] for t in STATES)) for s in STATES))[0]


_row_forward = cache(lambda vector, kind: forward(vector, row_matrix(kind)))
_row_backward = cache(lambda cost, kind: backward(cost, row_matrix(kind)))


def stretch(kinds: bytes) -> Matrix:
    """The matrix of a stretch of rows, one forward pass from each state."""
    costs, orders = [], []
    for s in STATES:
        vector, total = start(s), 0
        for kind in kinds:
            vector, low = _row_forward(vector, kind)
            total += low
        costs.append(tuple(c + total if c < NEVER else NEVER for c in vector.cost))
        orders.append(vector.order)
    return Matrix(tuple(costs), tuple(orders))


def crossings(parts: list, entry: int, end: tuple[int, ...], ahead: Callable, back: Callable) -> list[int]:
    """The state behind every part: forward and backward vectors meet in the middle, both halves are solved alike.

    ``end`` are the costs that follow the last part; ``ahead`` and ``back`` pass a vector through a part.
    """
    out = [0] * len(parts)
    todo = [(0, len(parts), entry, end)] if parts else []
    while todo:
        lo, hi, first, last = todo.pop()
        middle = (lo + hi + 1) // 2  # the crossing lies behind the part before it
        vector = start(first)
        for part in parts[lo:middle]:
            vector = ahead(vector, part)[0]
        rest = last
        for part in reversed(parts[middle:hi]):
            rest = back(rest, part)
        at = min((vector.cost[s] + rest[s], vector.order[s], s) for s in STATES if vector.cost[s] < NEVER)[2]
        out[middle - 1] = at
        if middle - 1 > lo:
            todo.append((lo, middle - 1, first, _before(parts[middle - 1], at, back)))
        if hi > middle:
            todo.append((middle, hi, at, last))
    return out


def _before(part, state: int, back: Callable) -> tuple[int, ...]:
    return back(tuple(0 if s == state else NEVER for s in STATES), part)


def row_edits(kinds: bytes, entry: int, end: tuple[int, ...]) -> list[str]:
    """The edits of every row of a stretch, each with the insertions in front of it."""
    states = crossings(list(kinds), entry, end, _row_forward, _row_backward)
    return [best_edits(kind, a)[b][1] for kind, a, b in zip(kinds, [entry, *states], states)]


END = tuple(INSERT * len(t) for t in TAIL)


def _filled(kinds: bytes, edits: list[str], entry: int) -> tuple[list[str | None], list[str | None], list[bool], int]:
    """(role inserted in front, new role, whether it stays) of every row, and the state behind the last."""
    inserted, renamed, stays, state = [], [], [], entry
    for kind, edit in zip(kinds, edits, strict=True):
        role, behind = FILLED[state]
        inserted.append(role if edit[0] == "I" else None)
        state = behind if edit[0] == "I" else state
        role, behind = FILLED[state]
        renamed.append(role if edit[-1] == "R" else None)
        stays.append(edit[-1] != "D")
        state = {"D": state, "R": behind}.get(edit[-1]) if edit[-1] != "K" else NEXT[state][INITIALS[kind & 3]]
    return inserted, renamed, stays, state


def least_audit(kinds: bytes) -> str:
    """The audit of a whole conversation given by the classes of its rows."""
    states = crossings(list(kinds), 0, END, _row_forward, _row_backward)
    return "".join(row_edits(kinds, 0, END)) + TAIL[states[-1] if states else 0]


# --- on tables -------------------------------------------------------------------------------------------------------


def _entries(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, hash, key, kind, times): distinct rows of every conversation with their class, without texts."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    slim = rows.select(
        "conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("hash"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(*ENDS)).alias("cut")
    ).groupBy("conv", "turn", "role", "hash", "blank", "cut").agg(F.count("*").alias("times"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = slim.groupBy(F.col("conv").alias("of"), F.col("role").alias("seen_role"), F.col("hash").alias("seen_hash")).agg(
        F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = slim.join(seen, F.col("conv").eqNullSafe(F.col("of")) & (F.col("role") == F.col("seen_role")) & (F.col("hash") == F.col("seen_hash")), "left")
    initial = F.substring("role", 1, 1)
    kind = F.when(F.col("blank"), BLANK).when(F.col("first").isNotNull() & (F.col("first") != order), DUPLICATE).otherwise(
        F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + F.when(F.col("cut"), 4).otherwise(0))
    return met.select("conv", "turn", "role", "hash", kind.alias("kind"), "times")


def _key(conv: str, turn: str, role: str, digest: str) -> Column:
    """One binary that stands for a distinct row; nulls differ from every value."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in (conv, turn)]
    return F.unhex(F.sha2(F.concat_ws("\x1f", *part, F.char_length(role).cast("string"), F.col(role), F.hex(digest)), 256))


_FACTS = ("blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string, "
          "cost array<long>, order array<int>")


def _blocks(entries: DataFrame, block: int) -> DataFrame:
    """(conv, part, block, keys, kinds, times, facts...): consecutive rows of one conversation, in the order of part and block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        conv = object()
        held: list[tuple] = []

        def close() -> dict:
            nonlocal number
            kinds, times = bytes(r[3] for r in held), [r[4] for r in held]
            turns = [r[1] for r in held if r[1] is not None]
            initials = [r[2][:1] for r in held]
            again = sum(times) - len(times)
            matrix = stretch(kinds)
            made = {
                "conv": conv, "part": part, "block": number, "keys": [r[0] for r in held], "kinds": kinds, "times": times,
                "blank": sum(n for k, n in zip(kinds, times, strict=True) if k == BLANK),
                "duplicate": sum(n if k == DUPLICATE else n - 1 for k, n in zip(kinds, times, strict=True) if k != BLANK),
                "truncated": sum(k < GOES and k >= 4 for k in kinds),
                "illegal": again + sum(a + b not in LEGAL for a, b in pairwise(initials)),
                "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
                "first_initial": initials[0], "last_initial": initials[-1],
                "cost": [c + DELETE * again if c < NEVER else NEVER for row in matrix.cost for c in row], "order": [p for row in matrix.order for p in row]}
            held.clear()
            number += 1
            return made

        for batch in batches:
            out = []
            for c, *row in zip(*(batch.column(x).to_pylist() for x in ("conv", "key", "turn", "role", "kind", "times")), strict=True):
                if held and (c != conv or len(held) == block):
                    out.append(close())
                conv = c
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([close()], schema)

    ddl = f"conv {entries.schema['conv'].dataType.simpleString()}, part long, block long, keys array<binary>, kinds binary, times array<long>, {_FACTS}"
    empty = entries.sparkSession.createDataFrame([], ddl)
    schema = _arrow(empty)
    keyed = entries.withColumn("key", _key("conv", "turn", "role", "hash"))
    dealt = keyed.repartitionByRange("conv", "turn", "role", "hash").sortWithinPartitions("conv", "turn", "role", "hash")
    return dealt.select("conv", "key", "turn", "role", "kind", "times").mapInArrow(run, empty.schema)


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def _in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Whole conversations per task, their rows in order."""
    return df.repartition("conv").sortWithinPartitions("conv", *columns)


def _met(blocks: DataFrame) -> DataFrame:
    """(conv, part, block, entry, exit, last, ...): the states in which each block is entered and left, and what it adds to the report."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> Iterator[dict]:
            matrices = [Matrix(tuple(tuple(b["cost"][4 * s:4 * s + 4]) for s in STATES), tuple(tuple(b["order"][4 * s:4 * s + 4]) for s in STATES)) for b in held]
            states = crossings(matrices, 0, END, forward, backward)
            turn, initial = None, None
            for i, (b, matrix, entry, leave) in enumerate(zip(held, matrices, [0, *states], states)):
                last = i == len(held) - 1
                illegal = b["illegal"] + (initial is not None and initial + b["first_initial"] not in LEGAL)
                turns = b["turns"] - (turn is not None and b["first_turn"] == turn)
                initial = b["last_initial"]
                turn = b["last_turn"] if b["last_turn"] is not None else turn
                yield {k: b[k] for k in ("conv", "part", "block", "blank", "duplicate", "truncated", "first_turn", "last_turn")} | {
                    "entry": entry, "exit": leave, "last": last, "illegal": illegal, "turns": turns,
                    "edit_cost": matrix.cost[entry][leave] + (END[leave] if last else 0)}
            held.clear()

        for batch in batches:
            out: list[dict] = []
            for b in batch.to_pylist():
                if held and held[0]["conv"] != b["conv"]:
                    out += close()
                held.append(b)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(list(close()), schema)

    ddl = (f"conv {blocks.schema['conv'].dataType.simpleString()}, part long, block long, blank long, duplicate long, truncated long, first_turn long, last_turn long, "
           "entry int, exit int, last boolean, illegal long, turns long, edit_cost long")
    empty = blocks.sparkSession.createDataFrame([], ddl)
    schema = _arrow(empty)
    return _in_order(blocks.drop("keys", "kinds", "times"), "part", "block").mapInArrow(run, empty.schema)


def _solved(blocks: DataFrame) -> DataFrame:
    """(conv, part, block, last, audit, rows, tail): the edits of every block, between its two states."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                end = tuple(0 if s == b["exit"] else NEVER for s in STATES)
                edits = row_edits(b["kinds"], b["entry"], end)
                inserted, renamed, stays, state = _filled(b["kinds"], edits, b["entry"])
                tail = TAIL[state] if b["last"] else ""
                roles = []
                for _ in tail:
                    role, state = FILLED[state]
                    roles.append(role)
                audit = "".join(e + "D" * (n - 1) for e, n in zip(edits, b["times"], strict=True)) + tail
                rows = [{"key": k, "inserted": i, "renamed": r, "stays": x} for k, i, r, x in zip(b["keys"], inserted, renamed, stays, strict=True)]
                out.append({k: b[k] for k in ("conv", "part", "block", "entry", "exit", "last")} | {"audit": audit, "rows": rows, "tail": roles})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    kind = blocks.schema["conv"].dataType.simpleString()
    ddl = (f"conv {kind}, part long, block long, entry int, exit int, last boolean, audit string, "
           "rows array<struct<key:binary,inserted:string,renamed:string,stays:boolean>>, tail array<string>")
    empty = blocks.sparkSession.createDataFrame([], ddl)
    schema = _arrow(empty)
    return blocks.mapInArrow(run, empty.schema)


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired) of conversations.

    reports: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conversation; repaired: (conv_id, place, turn,
    role, text), the turns after the cheapest edits, inserted ones with a null turn; ``place`` gives their order.
    """
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    blocks = stored(_blocks(_entries(rows), block), "conversation-blocks")
    met = stored(_met(blocks), "conversation-states")
    parted = blocks.select("conv", "part", "block", "keys", "kinds", "times").join(met.select("part", "block", "entry", "exit", "last"), ["part", "block"])
    solved = stored(_solved(parted), "conversation-edits")

    audits = solved.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "block", "audit"))).alias("audits"))
    summed = met.groupBy(F.col("conv").alias("of")).agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")), F.sum("edit_cost").alias("cost"),
        F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"))
    reports = audits.join(summed, F.col("conv").eqNullSafe(F.col("of"))).select(
        F.col("conv").alias("conv_id"), F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", F.array_join(F.transform("audits", lambda a: a["audit"]), "").alias("audit"))

    def place(at: Column, sub: int | Column) -> Column:
        return F.struct("part", "block", at.cast("long").alias("at"), (F.lit(sub) if isinstance(sub, int) else sub).cast("int").alias("sub")).alias("place")

    every = solved.select("conv", "part", "block", F.posexplode("rows").alias("at", "row"))
    nowhere, empty = F.lit(None).cast("long").alias("turn"), F.lit("").alias("text")
    inserted = every.filter("row.inserted IS NOT NULL").select("conv", place(F.col("at"), 0), nowhere, F.col("row.inserted").alias("role"), empty)
    ends = solved.select("conv", "part", "block", F.size("rows").alias("at"), F.posexplode("tail").alias("sub", "role"))
    added = ends.select("conv", place(F.col("at"), F.col("sub")), nowhere, "role", empty)
    stay = every.filter("row.stays").select("conv", place(F.col("at"), 1), F.col("row.key").alias("key"), F.col("row.renamed").alias("renamed"))
    texts = rows.withColumn("hash", F.unhex(F.sha2("text", 256))).select(_key("conv", "turn", "role", "hash").alias("key"), "turn", "role", "text").groupBy("key").agg(
        F.first("turn").alias("turn"), F.first("role").alias("role"), F.first("text").alias("text"))
    kept = stay.join(texts, "key").select("conv", "place", "turn", F.coalesce("renamed", "role").alias("role"), "text")
    return reports, kept.unionByName(inserted).unionByName(added).withColumnRenamed("conv", "conv_id")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations with turns: SHA-256 of ``role:text`` lines in order, read as a stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text")), strict=True):
                if digest is not None and c != conv:
                    out.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                    digest = None
                line = f"{role}:{text}".encode()
                if digest is None:
                    conv, digest = c, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)

    empty = repaired.sparkSession.createDataFrame([], f"conv {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    schema = _arrow(empty)
    lines = repaired.select(F.col("conv_id").alias("conv"), "place", "role", "text")
    return _in_order(lines, "place").select("conv", "role", "text").mapInArrow(run, empty.schema).withColumnRenamed("conv", "conv_id")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by the CRC-32 of ``conv_id:turn``, modulo 20; nulls read as one blank there.

    0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 gives it the role user; null roles and texts read as one blank.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def with_digests(ids: DataFrame, reports: DataFrame, repaired: DataFrame) -> DataFrame:
    """The reports with ``repaired_sha256``, one row per distinct id of ``ids``; zeros and empty texts for an id without rows."""
    every = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    made = digests(repaired).withColumnRenamed("conv_id", "of")
    met = every.join(reports, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(made, F.col("id").eqNullSafe(F.col("of")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return met.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
