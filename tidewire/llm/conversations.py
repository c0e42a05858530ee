"""Conversation structure repair: the cheapest edits that make turns follow the grammar ``(s?(ua)+)?``.

An optional system turn, then user and assistant in turns.  A row may be kept, given the
role that the grammar wants next (user or assistant), or deleted; empty turns may be
inserted anywhere.  Blank rows and repeats must be deleted, and a row that breaks off costs
extra unless it is deleted.

The cheapest edits come from a backward pass, which tells for every row and grammar state
what the rest costs at least, and a greedy forward walk, which takes at every step the edit
with the least letter among those that still reach that cost: the audit (D, I, K, R for
delete, insert, keep, rerole) is then the least in ASCII order of all cheapest ones.

A conversation's rows come to one task as a sorted stream, first from its end, then from its
start, and a task holds one batch of rows and one state, so a conversation may be of any
length; its hash can't be taken in another way.  Costs ahead of a row are kept as
differences, of which there are few, so every kind of row and costs ahead is worked out once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The costs of edits, and of a row that breaks off and stays; what parts words.
DELETE, REROLE, INSERT, BROKEN = 2, 1, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: Grammar states: before all turns, after the system's, a user's, an assistant's.  What the grammar wants next but for a system turn, and that turn's role.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What it costs to end in a state: the turns that must be inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: Differences of costs are below this.
BASE = 32

LETTERS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FAULTS = ("blank", "duplicate", "truncated")
TURN = "place int, edit string, role string, text string, turn long, was string, fault string, cost int"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def packed(costs: tuple[int, ...]) -> int:
    """Costs of the four states as one number that tells their differences."""
    least = min(costs)
    return sum((c - least) * BASE**n for n, c in enumerate(costs))


def unpacked(code: int) -> tuple[int, ...]:
    return tuple(code // BASE**n % BASE for n in range(4))


@cache
def step(ahead: int, initial: str, fault: str | None) -> tuple[int, tuple[str, ...]]:
    """Costs before a row, given those after it, and for each state the edits up to and including the row's own."""
    after, extra = unpacked(ahead), BROKEN if fault == "truncated" else 0
    own = LETTERS.get(initial)
    ways: list[dict[str, int]] = []  # by state, the row's own edits with what they and the rest cost
    for state in range(4):
        way = {"D": DELETE + after[state]}
        if fault not in ("blank", "duplicate"):
            if own == WANTED[state] or (own == SYSTEM and state == START):
                way["K"] = extra + after[own]
            way["R"] = REROLE + extra + after[WANTED[state]]
        ways.append(way)
    before = [min(w.values()) for w in ways]
    for _ in range(3):
        before = [min(c, INSERT + before[WANTED[n]]) for n, c in enumerate(before)]
    edits = []
    for state in range(4):
        said = ""
        while True:
            options = ways[state] | {"I": INSERT + before[WANTED[state]]}
            best = min(k for k, v in options.items() if v == before[state])
            said += best
            if best != "I":
                break
            state = WANTED[state]
        edits.append(said)
    return packed(tuple(before)), tuple(edits)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text: conversations with faults put in where a checksum of conversation and turn says so.

    Of 20 rows one is dropped, one loses its text, one its ends of sentences, one is there
    twice, and one has its role set to user.  Null roles and texts become one blank.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")) % 20
    own = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), name(role).alias("role"), name(text).alias("text"), fate.alias("fate")).where("fate <> 0")
    words = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    own = own.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), words.alias("text"), F.explode(F.expr("sequence(1, if(fate = 3, 2, 1))")).alias("copy"))
    return own.drop("copy")


def _faulty(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation, with their place in it and their first fault."""
    core = F.rtrim("text", F.lit(BLANKS))
    own = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    ).withColumn("_h", F.md5(F.col("text").cast("binary"))).withColumn("_last", F.right(core, F.lit(1)))
    own = own.repartition("conv_id").withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "_h")))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "_h").orderBy("_n")) > 1
    fault = F.when(F.col("_last") == "", "blank").when(again, "duplicate").when(~F.col("_last").isin(".", "!", "?"), "truncated")
    return own.withColumn("fault", fault).drop("_h", "_last")


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows, last first, the costs after each."""
    conv, ahead = object(), 0
    for b in batches:
        out = []
        for c, role, fault in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["fault"].to_pylist()):
            if c != conv:
                conv, ahead = c, packed(END)
            out.append(ahead)
            ahead = step(ahead, role[:1], fault)[0]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*b.schema.names, "ahead"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of rows that come first to last, in order, each with the turn it makes or deletes."""
    conv, state, place = object(), START, 0
    names = [x.split()[0] for x in TURN.split(", ")]
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def table(ids: list, rows: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, t) for c, t in zip(columns, types))], ["conv_id", *names])

    kind = None
    for b in batches:
        ids, rows, kind = [], [], b.schema.field("conv_id").type

        def put(edit: str, role: str, text: str, turn: int | None, was: str | None, fault: str | None, cost: int) -> None:
            nonlocal place
            place += 1
            ids.append(conv)
            rows.append((place, edit, role, text, turn, was, fault, cost))

        def insert() -> None:
            nonlocal state
            state = WANTED[state]
            put("I", ROLES[state], "", None, None, None, INSERT)

        for c, turn, role, text, fault, ahead in zip(*(b[k].to_pylist() for k in ("conv_id", "turn", "role", "text", "fault", "ahead"))):
            if c != conv:
                while END[state]:
                    insert()
                conv, state, place = c, START, 0
            *inserts, edit = step(ahead, role[:1], fault)[1][state]
            for _ in inserts:
                insert()
            extra = BROKEN if fault == "truncated" else 0
            if edit == "D":
                put("D", role, text, turn, role, fault, DELETE)
            elif edit == "K":
                state = LETTERS[role[:1]]
                put("K", role, text, turn, role, fault, extra)
            else:
                state = WANTED[state]
                put("R", ROLES[state], text, turn, role, fault, REROLE + extra)
        yield table(ids, rows, kind)
    if kind is not None and END[state]:
        ids, rows = [], []
        while END[state]:
            state, place = WANTED[state], place + 1
            ids.append(conv)
            rows.append((place, "I", ROLES[state], "", None, None, None, INSERT))
        yield table(ids, rows, kind)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text, turn, was, fault, cost: the cheapest edits of each conversation, in order.

    ``rows`` has conv_id, turn, role and text; other columns play no part.  Rows are in
    order of turn (null first), then role, then a digest of the text; equal rows are told
    apart by nothing and may stand in either order.  A null role or text is one blank, rows
    without a conv_id are one conversation.  A row's role counts by its first letter.
    What is deleted is there with its edit D; the repaired conversation is the rest.
    Each partition holds whole conversations, in order.
    """
    own = _faulty(rows)
    kind = own.schema["conv_id"].dataType.simpleString()
    ready = own.sortWithinPartitions("conv_id", F.desc("_n")).mapInArrow(_backward, f"conv_id {kind}, turn long, role string, text string, _n int, fault string, ahead int")
    return ready.sortWithinPartitions("conv_id", "_n").mapInArrow(_forward, f"conv_id {kind}, {TURN}")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, kind, own = None, None, None
    names = [x.split()[0] for x in SUMMARY.split(", ")]

    def fresh() -> dict:
        return {"n": dict.fromkeys((*FAULTS, "illegal", "cost"), 0), "turns": None, "distinct": 0, "was": None, "audit": [], "sha": hashlib.sha256(), "any": False}

    def done() -> tuple:
        gaps = 0 if own["turns"] is None else own["turns"][1] - own["turns"][0] + 1 - own["distinct"]
        return (gaps, *(own["n"][k] for k in (*FAULTS, "illegal", "cost")), "".join(own["audit"]), own["sha"].hexdigest())

    def table(ids: list, rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, pa.int64() if n < 6 else pa.string()) for n, c in enumerate(columns))], ["conv_id", *names])

    for b in batches:
        ids, rows, kind = [], [], b.schema.field("conv_id").type
        for c, edit, role, text, turn, was, fault, cost in zip(*(b[k].to_pylist() for k in ("conv_id", "edit", "role", "text", "turn", "was", "fault", "cost"))):
            if own is None or c != conv:
                if own is not None:
                    ids.append(conv)
                    rows.append(done())
                conv, own = c, fresh()
            n = own["n"]
            n["cost"] += cost
            if fault:
                n[fault] += 1
            if edit != "I":
                if own["was"] is not None and own["was"][:1] + was[:1] not in ("su", "ua", "au"):
                    n["illegal"] += 1
                own["was"] = was
                if turn is not None:  # rows come in order of turn
                    own["distinct"] += own["turns"] is None or own["turns"][1] != turn
                    own["turns"] = (turn if own["turns"] is None else own["turns"][0], turn)
            own["audit"].append(edit)
            if edit != "D":
                own["sha"].update(("\n" if own["any"] else "").encode() + f"{role}:{text}".encode())
                own["any"] = True
        yield table(ids, rows)
    if own is not None:
        yield table([conv], [done()])


def summaries(rows: DataFrame) -> DataFrame:
    """A row a conversation: its faults, what its repair costs, its audit, and the hash of what it becomes."""
    fixed = repair(rows)
    return fixed.mapInArrow(_summed, f"conv_id {fixed.schema['conv_id'].dataType.simpleString()}, {SUMMARY}")


def repaired_summaries(conversations: DataFrame) -> DataFrame:
    """``summaries`` of damaged conversations, one for each that there was before: of those with no row left, zeros, no audit and the hash of nothing."""
    ids = conversations.select("conv_id").distinct()
    own = summaries(damage(conversations)).withColumnRenamed("conv_id", "_c")
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    blank = {n: F.lit(0).cast("long") for n in names[:6]} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return ids.join(own, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select("conv_id", *(F.coalesce(n, blank[n]).alias(n) for n in names))
