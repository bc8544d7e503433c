"""Conversation structure repair by lightest derivations.

A conversation's turns are edited so that their roles read "system?, then user and assistant in
turns". Repair items are pairs (rows read, state of that grammar). Every deduction takes an item
and a row, or an inserted turn, to a further item and adds an edit: its cost and its letter. Items
wait on an agenda and are popped by (cost, audit letters), least first, until the goal item is
popped. Both parts of a weight only grow with an edit, and two derivations of one item that cost
the same are never one the start of the other (it would need an insertion more, which costs), so
the functions are superior and monotone, and what is popped first is final.

Turns are dealt out by ranges of (conversation, turn), so a conversation of any length is spread
over tasks. A piece that may not be a whole conversation, or is longer than ``most`` rows, is
solved from every state it may be entered in; the pieces' results, a few rows each, are put
together by the same deductions with a whole piece as one edit.

Fixed values: K keep 0, R other role 1, D delete 2, I insert 5, and 5 for a truncated row that stays.

Defined cases: rows follow turn (NULL first), role, text; a NULL role or text is one space; rows
equal in all of these are one row with a count, of which all but the first are duplicates; a NULL
conversation id is a conversation of its own; a role that begins with none of s, u, a cannot be
kept; extra columns are ignored; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tripstrata.llm.base import SPACES, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# state -> {role letter: next state}: start, after system, after user, after assistant
MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTED = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
MOST_ROWS = 500

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
PATHS = T.ArrayType(
    T.StructType(
        [
            T.StructField("entry", T.IntegerType()),
            T.StructField("exit", T.IntegerType()),
            T.StructField("cost", T.LongType()),
            T.StructField("audit", T.StringType()),
            T.StructField("turns", TURNS),
        ]
    )
)
COUNTS = ("blank", "duplicate", "truncated", "illegal")

# a row as the deductions see it: role letter, must it go, what it costs when it stays
Row = tuple[str, bool, int]


def lightest(rows: list[Row], entry: int, goals: set[tuple[int, int]], first: bool = False) -> dict[tuple[int, int], tuple[int, str]]:
    """Weight ``(cost, audit)`` of each item of ``goals`` that can be derived from ``(0, entry)``; of the lightest one alone if ``first``."""
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    final: dict[tuple[int, int], tuple[int, str]] = {}
    wanted = set(goals)
    while agenda and wanted:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final[at, state] = cost, audit
        if (at, state) in wanted:
            wanted = set() if first else wanted - {(at, state)}
        for letter, after in MOVES[state].items():
            if letter in ROLES and (at, after) not in final:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", at, after))
        if at == len(rows):
            continue
        initial, must_go, stays = rows[at]
        heapq.heappush(agenda, (cost + DELETE, audit + "D", at + 1, state))
        if must_go:
            continue
        for letter, after in MOVES[state].items():
            if letter == initial:
                heapq.heappush(agenda, (cost + KEEP + stays, audit + "K", at + 1, after))
            elif letter in ROLES:
                heapq.heappush(agenda, (cost + REROLE + stays, audit + "R", at + 1, after))
    return {item: final[item] for item in goals if item in final}


def applied(turns: list[tuple[str, str]], entry: int, audit: str) -> list[dict]:
    """The turns that ``audit`` leaves; the grammar knows the role of each edit."""
    out, state, at = [], entry, 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text = turns[at]
            letter = role[:1]
        else:
            letter = next(x for x in MOVES[state] if x in ROLES)
            role, text = ROLES[letter], "" if edit == "I" else turns[at][1]
        at += edit != "I"
        out.append({"role": role, "text": text})
        state = MOVES[state][letter]
    return out


def solved(rows: list[Row], turns: list[tuple[str, str]], entries: list[int], last: bool) -> list[dict]:
    """Paths through a piece: from each entry the lightest to each exit, or the lightest accepted one."""
    paths = []
    for entry in entries:
        found = lightest(rows, entry, {(len(rows), state) for state in (ACCEPTED if last else MOVES)}, last)
        for cost, audit, state in sorted((*weight, item[1]) for item, weight in found.items()):
            paths.append({"entry": entry, "exit": state, "cost": cost, "audit": audit, "turns": applied(turns, entry, audit)})
    return paths


def _pieces(kind: T.DataType, most: int) -> tuple[Callable, T.StructType]:
    schema = T.StructType(
        [
            T.StructField("conv", kind),
            T.StructField("piece", T.LongType()),
            T.StructField("whole", T.BooleanType()),
            T.StructField("first", T.StringType()),
            T.StructField("last", T.StringType()),
            *[T.StructField(name, T.LongType()) for name in COUNTS],
            T.StructField("paths", PATHS),
        ]
    )
    arrow = to_arrow_schema(schema)

    def piece(conv, number: int, rows: list, whole: bool) -> dict:
        deduced, turns, counts = [], [], dict.fromkeys(COUNTS, 0)
        before = None
        for role, text, copies, new in rows:
            said = text.rstrip(SPACES)
            for copy in range(copies):
                fault = "blank" if not said else "duplicate" if copy or not new else "" if said[-1] in ".!?" else "truncated"
                if fault:
                    counts[fault] += 1
                counts["illegal"] += before is not None and before + role[:1] not in LEGAL
                before = role[:1]
                deduced.append((role[:1], fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0))
                turns.append((role, text))
        paths = solved(deduced, turns, [0] if whole else list(MOVES), whole)
        return {"conv": conv, "piece": number, "whole": whole, "first": deduced[0][0], "last": before, **counts, "paths": paths}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, conv, part, number, begun = [], 0, None, None, 0, False
        done: list[dict] = []
        edge = True  # the task's first conversation may have begun in another task

        def close(whole: bool) -> None:
            nonlocal held, size, number, begun
            if held:
                done.append(piece(conv, (part << 33) + number, held, whole and not begun))
                number, begun, held, size = number + 1, True, [], 0

        for batch in batches:
            for here, key, role, text, copies, new in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if part is None:
                    part, conv = here, key
                if key != conv:
                    close(not edge)
                    conv, begun, edge = key, False, False
                while copies:
                    some = min(copies, most - size)
                    held.append((role, text, some, new))
                    size, copies, new = size + some, copies - some, False
                    if size >= most:
                        close(False)
            if len(done) >= 200:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        close(False)  # the last one may go on in another task
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    return scan, schema


def _chosen(kind: T.DataType) -> tuple[Callable, T.StructType]:
    schema = T.StructType([T.StructField("conv", kind), T.StructField("piece", T.LongType()), T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()), T.StructField("seam", T.LongType())])
    arrow = to_arrow_schema(schema)

    def finish(conv, reached: dict) -> list[dict]:
        weight = min((reached[state][:2], state) for state in ACCEPTED if state in reached)
        out, step = [], reached[weight[1]][2]
        while step:
            step, number, entry, state, seam = step
            out.append({"conv": conv, "piece": number, "entry": entry, "exit": state, "seam": seam})
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = {0: (0, "", None)}
        conv, reached, before = None, None, None
        for batch in batches:
            out = []
            for key, number, initial, ending, paths in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if reached is None or key != conv:
                    out += finish(conv, reached) if reached else []
                    conv, reached, before = key, start, None
                seam = int(before is not None and before + initial not in LEGAL)
                before, ahead = ending, {}
                for path in paths:
                    if path["entry"] in reached:
                        cost, audit, step = reached[path["entry"]]
                        found = (cost + path["cost"], audit + path["audit"], (step, number, path["entry"], path["exit"], seam))
                        if path["exit"] not in ahead or found[:2] < ahead[path["exit"]][:2]:
                            ahead[path["exit"]] = found
                reached = ahead
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if reached:
            yield pa.RecordBatch.from_pylist(finish(conv, reached), arrow)

    return scan, schema


def ordered_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, turn, role, text, copies, new)``: equal rows as one; ``new`` where role and text come up first."""
    space = F.lit(" ")
    rows = turns.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"),
        F.coalesce(F.col(text_col), space).alias("text"),
    )
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("said", F.sha2(F.concat_ws("\x00", "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = rows.groupBy("conv", "said").agg(F.min(place).alias("earliest"))
    both = rows.alias("l").join(firsts.alias("r"), F.col("l.conv").eqNullSafe(F.col("r.conv")) & (F.col("l.said") == F.col("r.said")))
    new = F.col("r.earliest.turn").eqNullSafe(F.col("l.turn"))
    return staged(both.select("l.conv", "l.turn", "l.role", "l.text", "copies", new.alias("new")), "repair-turns")


def repair(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = MOST_ROWS, width: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(facts, pieces)``.

    ``facts``: ``(conv, gaps, blank, duplicate, truncated, illegal, cost)``, one row per conversation.
    ``pieces``: ``(conv, piece, audit, turns)``, the repaired conversation in rows of bounded length.
    """
    rows = ordered_turns(turns, id_col, turn_col, role_col, text_col)
    kind = rows.schema["conv"].dataType
    order: list[Column | str] = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartitionByRange(width, *order) if width else rows.repartitionByRange(*order)
    scan, schema = _pieces(kind, most)
    sorted_rows = dealt.sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv", "role", "text", F.col("copies").cast("int"), "new")
    pieces = staged(sorted_rows.mapInArrow(scan, schema), "repair-pieces")

    choose, chosen_schema = _chosen(kind)
    open_pieces = pieces.where("NOT whole").select("conv", "piece", "first", "last", F.transform("paths", lambda p: p.dropFields("turns")).alias("paths"))
    chosen = open_pieces.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(choose, chosen_schema)
    same = F.col("p.conv").eqNullSafe(F.col("c.conv")) & (F.col("p.piece") == F.col("c.piece"))
    picked = pieces.alias("p").join(chosen.alias("c"), same, "left")
    fits = lambda path: F.col("whole") | ((path.entry == F.col("c.entry")) & (path.exit == F.col("c.exit")))
    path = F.filter("paths", fits)[0]
    illegal = (F.col("illegal") + F.coalesce("c.seam", F.lit(0))).alias("illegal")
    result = staged(picked.select("p.conv", "p.piece", *COUNTS[:3], illegal, path.alias("path")), "repair-result")

    numbers = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    summed = result.groupBy("conv").agg(*[F.sum(name).alias(name) for name in COUNTS], F.sum("path.cost").alias("cost"))
    facts = summed.alias("s").join(numbers.alias("n"), F.col("s.conv").eqNullSafe(F.col("n.conv")))
    facts = facts.select("s.conv", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), *COUNTS, F.col("cost").cast("bigint").alias("cost"))
    return facts, result.select("conv", "piece", F.col("path.audit").alias("audit"), F.col("path.turns").alias("turns"))


def digests(pieces: DataFrame, key: str = "conv") -> DataFrame:
    """``(conv, audit, repaired_sha256)``: pieces streamed in order into one hash per conversation, never held together."""
    kind = pieces.schema[key].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)
    written = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, text = None, None, hashlib.sha256()
        empty = True

        def row() -> dict:
            return {"conv": conv, "audit": "".join(audit), "repaired_sha256": text.hexdigest()}

        for batch in batches:
            out = []
            for name, edits, lines, turns in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if audit is None or name != conv:
                    if audit is not None:
                        out.append(row())
                    conv, audit, text, empty = name, [], hashlib.sha256(), True
                audit.append(edits)
                if turns:
                    text.update((("" if empty else "\n") + lines).encode())
                    empty = False
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if audit is not None:
            yield pa.RecordBatch.from_pylist([row()], arrow)

    rows = pieces.select(F.col(key).alias("conv"), "piece", "audit", written.alias("lines"), F.size("turns").alias("turns"))
    return rows.repartition("conv").sortWithinPartitions("conv", "piece").select("conv", "audit", "lines", "turns").mapInArrow(scan, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by the remainder of a checksum of ``conv_id:turn``: dropped, emptied, cut, repeated or given a role."""
    space = F.lit(" ")
    part = lambda name: F.coalesce(F.col(name).cast("string"), space)
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")
