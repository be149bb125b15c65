"""Repair of conversations' turn structure: backward cost-to-go, then a greedy forward walk.

A repaired conversation's role initials follow the grammar ``(s?(ua)+)?``. Edits and costs: Keep 0, Rerole to user or
assistant 2, Delete 3 (a must for blank and duplicate rows), Insert an empty user or assistant turn 2; a truncated row
that stays adds 1.

1. Rows that are equal in all columns become one with a number. The first row of a (role, text) of its conversation is
   found by an aggregate and joined back, so nothing gathers a conversation's rows.
2. Rows are dealt to ranges of (conversation, turn): blocks. A conversation of any length is as many blocks as it has
   ranges. A block tells for each of the grammar's four states what it costs to leave it in each state; a conversation's
   blocks are then combined from the last to the first, which gives each the cost-to-go behind it, and from the first
   to the last, which gives each the state that it begins in: two small tables, a row for each block of a conversation
   that has several.
3. Within a block, costs-to-go are computed from its last row to its first for each state; a walk from its first row
   takes the ASCII-least letter among the edits that are tight (their cost and the cost-to-go behind them make up the
   cost-to-go). A letter leads to one state only, so this is the ASCII-least of the cheapest edit strings.

Nulls: a null role or text is one space; rows with a null turn come first; a null conv_id is a conversation of its own.
Rows of one turn stand in the order of role, then text; repeated rows are duplicates of the first. Very long texts are
handled as wholes, a row at a time. A role's initial is its first character; other initials than s, u and a can't be
kept. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

INF = 1 << 60
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
AFTER = {"s": 1, "u": 2, "a": 3}
TAKES = ("su", "u", "a", "u")
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
#: Cost from each state to the end of the conversation, by insertions alone.
END = (0, 4, 2, 0)
INSERT, REROLE, DELETE = 2, 2, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def damaged(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with repeatable damage by crc32(conv_id:turn) % 20; see the query's contract."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), d.alias("d")).filter("d <> 0")
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    body = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select("conv_id", "turn", role.alias("role"), body.alias("text"), copies.alias("copy")).drop("copy")


def _judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rest (0, or 1 for the further ones of equal rows), times, fault (0: none)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("role"), text("text").alias("text"))
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("c"))
    place: Column = F.struct(F.col("turn").isNotNull().alias("set"), F.coalesce("turn", F.lit(0)).alias("turn"))
    once = once.withColumns({"place": place, "key": F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"))})
    first = once.groupBy("conv_id", "key").agg(F.min("place").alias("first")).withColumnsRenamed({"conv_id": "_conv", "key": "_key"})
    seen = once.join(first, once["conv_id"].eqNullSafe(first["_conv"]) & (once["key"] == first["_key"]))
    parts = F.array(F.struct(F.lit(0).alias("rest"), F.lit(1).cast("long").alias("times")), F.struct(F.lit(1).alias("rest"), (F.col("c") - 1).alias("times")))
    each = seen.withColumn("p", F.explode(F.filter(parts, lambda p: p["times"] > 0)))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when((F.col("place") > F.col("first")) | (F.col("p.rest") > 0), DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(0)
    )
    return each.select("conv_id", "turn", "role", "text", "p.rest", "p.times", fault.alias("fault"))


def _symbols(t: pa.Table) -> list[tuple[str, int, int]]:
    """(initial of the role, fault, times) of each row."""
    return list(zip((r[:1] for r in t["role"].to_pylist()), t["fault"].to_pylist(), t["times"].to_pylist(), strict=True))


def _choices(state: int, row: tuple[str, int, int], after: list[int] | tuple[int, ...]) -> list[tuple[int, str, int]]:
    """(cost-to-go, letter, next state) of the edits that take the row, in the order of their letters."""
    initial, fault, times = row
    out = [(DELETE * times + after[state], "D", state)]
    if fault not in (BLANK, DUPLICATE):
        extra = fault == TRUNCATED
        if initial and initial in TAKES[state]:
            out.append((extra + after[AFTER[initial]], "K", AFTER[initial]))
        out.append((REROLE + extra + after[NEXT[state]], "R", NEXT[state]))
    return out


def cost_to_go(rows: list[tuple[str, int, int]], exit_cost: list[int] | tuple[int, ...]) -> list[list[int]]:
    """For each row and behind the last: the least cost from each state to the end, exit_cost being what leaving in it costs."""
    out = [list(exit_cost)]
    for row in reversed(rows):
        c = [min(x[0] for x in _choices(s, row, out[-1])) for s in range(4)]
        u, a = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
        out.append([min(c[0], INSERT + u), min(c[1], INSERT + u), u, a])
    return out[::-1]


def walked(rows: list[tuple[str, int, int]], costs: list[list[int]], state: int, last: bool) -> tuple[list[tuple[int, str, int]], int]:
    """The cheapest edits from ``state`` on, ASCII-least letters first: (row, letter, state after it), and the last state.

    last: the conversation ends here, so that turns may be inserted behind its last row.
    """
    out: list[tuple[int, str, int]] = []
    for i, row in enumerate(rows):
        while True:
            options = [*_choices(state, row, costs[i + 1]), (INSERT + costs[i][NEXT[state]], "I", NEXT[state])]
            _, letter, state = min((x for x in options if x[0] == costs[i][state]), key=lambda x: x[1])
            out.append((i, letter, state))
            if letter != "I":
                break
    while last and END[state]:
        state = NEXT[state]
        out.append((len(rows), "I", state))
    return out, state


def _parts(t: pa.Table) -> Iterator[pa.Table]:
    """The conversations of a block, each in its order."""
    t = t.sort_by("at")
    ids, a = t["conv_id"].to_pylist(), 0
    for b in range(1, len(ids) + 1):
        if b == len(ids) or ids[b] != ids[a]:
            yield t.slice(a, b - a)
            a = b


def _block_costs(t: pa.Table) -> pa.Table:
    out = []
    for p in _parts(t):
        rows = _symbols(p)
        by_exit = [cost_to_go(rows, [0 if s == e else INF for s in range(4)])[0] for e in range(4)]
        out.append({"conv_id": p["conv_id"][0].as_py(), "block": p["block"][0].as_py(), "costs": [by_exit[e][s] for s in range(4) for e in range(4)]})
    return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))]))


def _exits(t: pa.Table) -> pa.Table:
    """What it costs to leave each block of a conversation in each state."""
    out, after = [], list(END)
    for r in reversed(t.sort_by("block").to_pylist()):
        out.append({"conv_id": r["conv_id"], "block": r["block"], "leave": list(after), "last": not out})
        after = [min(r["costs"][4 * s + e] + after[e] for e in range(4)) for s in range(4)]
    kinds = [("conv_id", pa.int64()), ("block", pa.int64()), ("leave", pa.list_(pa.int64())), ("last", pa.bool_())]
    return pa.Table.from_pylist(out, schema=pa.schema(kinds))


def _block_moves(t: pa.Table) -> pa.Table:
    """The state that each block is left in, by the state that it begins in."""
    out = []
    for p in _parts(t):
        rows, leave = _symbols(p), p["leave"][0].as_py()
        costs = cost_to_go(rows, leave)
        moves = [walked(rows, costs, s, False)[1] if costs[0][s] < INF else s for s in range(4)]
        out.append({"conv_id": p["conv_id"][0].as_py(), "block": p["block"][0].as_py(), "leave": leave, "last": p["last"][0].as_py(), "moves": moves})
    kinds = [("conv_id", pa.int64()), ("block", pa.int64()), ("leave", pa.list_(pa.int64())), ("last", pa.bool_()), ("moves", pa.list_(pa.int64()))]
    return pa.Table.from_pylist(out, schema=pa.schema(kinds))


def _entries(t: pa.Table) -> pa.Table:
    """The state that each block begins in."""
    out, state = [], 0
    for r in t.sort_by("block").to_pylist():
        out.append({"conv_id": r["conv_id"], "block": r["block"], "leave": r["leave"], "last": r["last"], "enter": state})
        state = r["moves"][state]
    kinds = [("conv_id", pa.int64()), ("block", pa.int64()), ("leave", pa.list_(pa.int64())), ("last", pa.bool_()), ("enter", pa.int64())]
    return pa.Table.from_pylist(out, schema=pa.schema(kinds))


_REPAIRED = "conv_id long, at long, k int, edit string, times long, role string, text string, was string, turn long, fault int"


def _repaired(t: pa.Table) -> pa.Table:
    """A block's edits, each with its turn."""
    out = []
    for p in _parts(t):
        rows, full = _symbols(p), p.to_pylist()
        leave, last, enter = full[0]["leave"] or list(END), full[0]["last"] is not False, full[0]["enter"] or 0
        edits, _ = walked(rows, cost_to_go(rows, leave), enter, last)
        for k, (i, letter, state) in enumerate(edits):
            r = full[min(i, len(full) - 1)]
            new = {"conv_id": r["conv_id"], "at": r["at"], "k": k, "edit": letter}
            if letter == "I":
                new |= {"times": 1, "role": NAMES[state], "text": "", "was": None, "turn": None, "fault": None}
            else:
                role = NAMES[state] if letter == "R" else r["role"]
                new |= {"times": r["times"], "role": role, "text": r["text"], "was": r["role"], "turn": r["turn"], "fault": r["fault"]}
            out.append(new)
    kinds = [("conv_id", pa.int64()), ("at", pa.int64()), ("k", pa.int32()), ("edit", pa.string()), ("times", pa.int64()), ("role", pa.string())]
    kinds += [("text", pa.string()), ("was", pa.string()), ("turn", pa.int64()), ("fault", pa.int32())]
    return pa.Table.from_pylist(out, schema=pa.schema(kinds))


def repaired_turns(rows: DataFrame, name: str = "conversations") -> DataFrame:
    """rows(conv_id, turn, role, text) -> the edits of each conversation in the order of (at, k), with the turns that they give.

    edit: K, R, D or I; role, text: of the repaired turn (of a deleted one, its own); was, turn, fault: of the row that
    an edit takes (null for inserted turns; fault 0 none, 1 blank, 2 duplicate, 3 truncated); times: equal rows that are
    deleted together, else 1.
    """
    spark = rows.sparkSession
    tmp = Scratch(spark, name)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("rest")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _judged(rows).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    turns = tmp.save(dealt.withColumn("block", F.shiftright("at", 33)), "turns")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    several = turns.groupBy("conv_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).filter("lo <> hi").select("conv_id")
    parted = turns.drop("text").join(several, same(turns, several), "left_semi")
    parted = tmp.save(parted, "parted")
    small = "conv_id long, block long, leave array<long>, last boolean"
    costs = parted.groupBy("block").applyInArrow(_block_costs, "conv_id long, block long, costs array<long>")
    exits = tmp.save(costs.groupBy("conv_id").applyInArrow(_exits, small), "exits")
    behind = parted.join(exits, same(parted, exits) & (parted["block"] == exits["block"]))
    behind = behind.select(*[parted[c] for c in parted.columns], "leave", "last")
    moves = behind.groupBy("block").applyInArrow(_block_moves, f"{small}, moves array<long>")
    begun = tmp.save(moves.groupBy("conv_id").applyInArrow(_entries, f"{small}, enter long"), "entries")
    known = turns.join(begun, same(turns, begun) & (turns["block"] == begun["block"]), "left")
    known = known.select(*[turns[c] for c in turns.columns], "leave", "last", "enter")
    return known.groupBy("block").applyInArrow(_repaired, _REPAIRED)


_DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """What is kept of a conversation while its repaired turns pass by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.hash, self.audit = conv_id, hashlib.sha256(), []
        self.turns: tuple[int, int, int] | None = None  # least, last, different ones
        self.faults, self.illegal, self.cost, self.first, self.initial = [0, 0, 0, 0], 0, 0, True, None

    def add(self, r: dict) -> None:
        times, edit = r["times"], r["edit"]
        self.audit.append(edit * times)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE * times, "I": INSERT}[edit]
        if r["was"] is not None:
            self.faults[r["fault"]] += times
            self.cost += edit != "D" and r["fault"] == TRUNCATED
            initial = r["was"][:1]
            self.illegal += times - 1
            if self.initial is not None:
                self.illegal += self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            if (t := r["turn"]) is not None:
                least, last, n = self.turns or (t, t, 1)
                self.turns = (least, t, n + (t != last))
        if edit != "D":
            self.hash.update(b"" if self.first else b"\n")
            self.hash.update(f"{r['role']}:{r['text']}".encode())
            self.first = False

    def row(self) -> dict:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        faults = dict(zip(("blank", "duplicate", "truncated"), self.faults[1:], strict=True))
        out = {"conv_id": self.conv_id, "gaps": gaps, **faults, "illegal": self.illegal, "cost": self.cost}
        return out | {"audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """Counts of faults, cost, edits and the digest of each conversation; its turns pass one after the other.

    A digest of a conversation's whole text can only be made in order, so its turns go through one task, which holds
    one of them at a time and the string of edits.
    """
    kinds = [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))]
    schema = pa.schema([*kinds, ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or now.conv_id != r["conv_id"]:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(r["conv_id"])
                now.add(r)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=schema)

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k").mapInArrow(run, _DIGESTS)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), damaged first, -> a row for each conv_id: faults, cost, edits, digest of the repaired turns."""
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = conversation_digests(repaired_turns(damaged(rows))).withColumnRenamed("conv_id", "_conv")
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["_conv"]), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
