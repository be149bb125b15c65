"""Packing documents into sequences by bin completion.

Lengths are whole numbers up to the capacity, so a packing is a list of fillings with how often each is used, and the
search runs on the histogram of lengths: at most ``capacity`` numbers come to the driver, however many documents there
are. The largest length left is completed by an undominated filling of what it leaves free; branch and bound tries the
next fillings while the waste so far stays below that of the best packing known, which begins as best fit. It ends when
a packing meets the lower bound, or after ``most_nodes`` fillings, with the best packing found.

Then each piece gets its place by its rank among the pieces of its length, in a distributed pass.

Only documents longer than the capacity are cut, into full pieces and a rest. Null texts hold the end id only; null
doc_ids are kept; a doc_id that comes twice is two documents; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ordered_prefix
from .tokens import encoder, parts, text_bytes

CAPACITY = 2048
PIECES = "doc_id long, row long, place long, piece int, start long, length long, ids_crc32 long"


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by large lengths that can't share (Martello and Toth's L2)."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    sizes = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        sizes[n] += c
    number, total = np.cumsum(sizes), np.cumsum(sizes * np.arange(capacity + 1))
    for k in range(capacity // 2 + 1):
        alone = number[capacity] - number[capacity - k]
        half = number[capacity - k] - number[capacity // 2]
        half_total = total[capacity - k] - total[capacity // 2]
        small = total[capacity // 2] - (total[k - 1] if k else 0)
        best = max(best, int(alone + half + max(0, -(-(small - (half * capacity - half_total)) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on the histogram: each filling takes the largest length that still fits, again and again."""
    left, out = Counter({n: c for n, c in counts.items() if c}), []
    have = sorted(left)
    while have:
        fill, room, used = [], capacity, Counter()
        at = len(have)
        while at and room:
            at = int(np.searchsorted(have[:at], room, side="right"))
            if not at:
                break
            n = have[at - 1]
            if used[n] < left[n] and n <= room:
                k = min(left[n] - used[n], room // n)
                fill += [n] * k
                used[n] += k
                room -= k * n
            at -= 1
        times = min(left[n] // k for n, k in used.items())
        out.append((tuple(fill), times))
        left.subtract({n: k * times for n, k in used.items()})
        have = [n for n in have if left[n] > 0]
    return out


class Lengths:
    """How many pieces of each length are left, with the lengths at hand as bits, so that sums are looked up by shifts."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, [0] * (capacity + 1)
        self.bits = self.mirror = 0  # bit n, and bit capacity - n, for each length n at hand
        for n, c in counts.items():
            self.take(n, -c)

    def take(self, n: int, times: int = 1) -> None:
        was, now = self.left[n], self.left[n] - times
        self.left[n] = now
        if (was > 0) != (now > 0):
            self.bits ^= 1 << n
            self.mirror ^= 1 << (self.capacity - n)

    def largest(self, most: int) -> int:
        """The largest length at hand that is at most ``most``, or 0."""
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.bits & ((2 << most) - 1) else 0

    def pairs(self, total: int, top: int) -> Iterator[tuple[int, int]]:
        """Pairs (a, b), top >= a >= b, that sum to total, largest a first."""
        if total < 2:
            return
        fine = self.bits & (self.mirror >> (self.capacity - total)) & ((2 << min(top, total - 1)) - 1)
        fine = fine >> ((total + 1) // 2) << ((total + 1) // 2)
        while fine:
            a = fine.bit_length() - 1
            fine ^= 1 << a
            if 2 * a != total or self.left[a] > 1:
                yield a, total - a

    def triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        """For each largest length x, the triple that sums to total with the largest second length."""
        x = self.largest(total - 2)
        while 3 * x >= total:
            rest = total - x
            if rest <= 2 * x and self.bits & (self.mirror >> (self.capacity - rest)) & ((2 << min(x, rest)) - 1):
                self.take(x)
                found = next(self.pairs(rest, x), None)
                self.take(x, -1)
                if found:
                    yield (x, *found)
            x = self.largest(x - 1)

    def sums(self, room: int) -> int:
        """Bits of the sums up to room of at most three lengths, as if none ran out."""
        whole, each, n = (2 << room) - 1, [], self.largest(room)
        while n:
            each.append(n)
            n = self.largest(n - 1)
        two = three = self.bits & whole
        for n in each:
            two |= self.bits << n & whole
        for n in each:
            three |= two << n & whole
        return three


def fillings(have: Lengths, room: int, most: int = 4) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of room from the lengths at hand, fullest first, up to ``most`` and the greedy one.

    Lengths too small to fill room by three are first taken greedily. One length that fits exactly dominates every other
    filling. Then come pairs and triples by their sum, with the largest length first (what they leave is easier to
    place), down to the largest single length or the greedy filling: what is less full than these is dominated by them.
    """
    head: list[int] = []
    while (n := have.largest(room)) and room > 3 * n:
        times = min(have.left[n], max(1, (room - 3 * n) // n))
        have.take(n, times)
        head += [n] * times
        room -= n * times
    single = have.largest(room)
    out: list[tuple[int, ...]] = []
    if single and single == room:
        out = [(room,)]
    elif single:
        greedy, rest = [], room
        while n := have.largest(rest):
            have.take(n)
            greedy.append(n)
            rest -= n
        for n in greedy:
            have.take(n, -1)
        out = list(itertools.islice(have.pairs(room, room), most)) or list(itertools.islice(have.triples(room), most))
        if not out:
            least = max(single, room - rest)
            sums = have.sums(room) >> least << least
            while sums and len(out) < most:
                total = sums.bit_length() - 1
                sums ^= 1 << total
                out += [(total,)] if total == single else []
                out += itertools.islice(have.pairs(total, total), most - len(out))
                out += itertools.islice(have.triples(total), most - len(out))
        if tuple(greedy) not in out and (not out or sum(out[0]) < room):
            out.append(tuple(greedy))
    for n in head:
        have.take(n, -1)
    yield from ((*head, *f) for f in out) if out else [tuple(head)]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, most_nodes: int = 20_000, pool: int = 64) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, largest first) with how often each is used; as few sequences in all as the search finds.

    Best fit is the first packing. While it misses the lower bound, the whole histogram is searched; if a gap is left,
    the ``pool`` emptiest sequences, with full ones where those are fewer, are packed anew, in turns.
    """
    counts = {int(n): int(c) for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    if not counts:
        return []
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    best = _search(counts, capacity, sum(k for _, k in best), bound, most_nodes) or best
    for turn in range(8):
        score = sum(k for _, k in best)
        if score == bound:
            break
        ranked_ = sorted(best, key=lambda f: (sum(f[0]) == capacity, sum(f[0])))
        out, rest, room = [], [], pool
        skip = turn * pool  # later turns take other full sequences to the empty ones
        for fill, times in ranked_:
            full = sum(fill) == capacity
            pass_ = min(times, skip) if full else 0
            skip -= pass_
            take = min(times - pass_, room)
            room -= take
            if take:
                out.append((fill, take))
            if times > take:
                rest.append((fill, times - take))
        some: Counter = Counter()
        for fill, times in out:
            for n in fill:
                some[n] += times
        now = sum(k for _, k in out)
        if now == score:
            break
        found = _search(some, capacity, now, max(lower_bound(some, capacity), now - (score - bound)), 500)
        if found:
            best = rest + found
    return best


def _search(counts: dict[int, int], capacity: int, score: int, bound: int, most_nodes: int) -> list[tuple[tuple[int, ...], int]] | None:
    """A packing in fewer than ``score`` sequences by depth-first branch and bound, or None; stops at ``bound``."""
    if score <= bound:
        return None
    best, total = None, sum(n * c for n, c in counts.items())
    have, rows = Lengths(counts, capacity), sum(counts.values())
    nodes = 0
    # Depth-first: each frame holds the fillings still to try and the one in use.
    stack: list[list] = []
    used, placed = 0, 0

    def options():
        top = have.largest(capacity)
        have.take(top)
        found = [(top, *sorted(f, reverse=True)) for f in fillings(have, capacity - top)]
        have.take(top, -1)
        return found

    def apply(fill, times):
        nonlocal used, placed, rows
        for n in fill:
            have.take(n, times)
        used, placed, rows = used + times, placed + times * sum(fill), rows - times * len(fill)

    stack.append([options(), None])
    while stack and nodes < most_nodes:
        frame = stack[-1]
        if frame[1]:
            apply(frame[1][0], -frame[1][1])
            frame[1] = None
        if not frame[0]:
            stack.pop()
            continue
        nodes += 1
        fill = frame[0].pop(0)
        times = min(have.left[n] // k for n, k in Counter(fill).items())
        if sum(fill) < capacity and times > 1 and len(stack) < 2000 and rows > times * len(fill):
            times //= 2
        if used + times + -(-(total - placed - times * sum(fill)) // capacity) >= score:
            continue
        apply(fill, times)
        frame[1] = (fill, times)
        if placed == total:
            best, score = [f[1] for f in stack], used
            if score == bound:
                break
            continue
        stack.append([options(), None])
    return best


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Id streams as unsigned 32-bit numbers, each closed by the end id, and where each begins (and the end)."""
    n = np.diff(at)
    wide = np.full(len(ids) + len(n), end_id, "<u4")
    wide[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return wide, at + np.arange(len(at))


def piece_table(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, place) -> a row for each piece, with its ids if asked for; row numbers the documents."""
    rows = docs.select("doc_id", "place", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        for batch in batches:
            for some in parts(batch, "text"):
                wide, at = with_end(*enc.encode(*text_bytes(some.column("text"))), end_id)
                sizes = np.diff(at)
                pieces = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), pieces)
                k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = k * capacity
                length = np.minimum(capacity, sizes[of] - start)
                begin = at[of] + start
                raw = memoryview(wide).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(begin.tolist(), length.tolist(), strict=True)]
                doc = pa.array(of)
                columns = [
                    some.column("doc_id").cast(pa.int64()).take(doc),
                    some.column("row").take(doc),
                    some.column("place").take(doc),
                    pa.array(k, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64())
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(wide)), pa.int32()), pa.array(wide, pa.int64())))
                yield pa.RecordBatch.from_arrays(
                    columns,
                    ["doc_id", "row", "place", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                )

    return rows.mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


def place_pieces(pieces: DataFrame, plan: list[tuple[tuple[int, ...], int]], counts: dict[int, int]) -> DataFrame:
    """pieces(..., rank), ranked by length, with sequence_id and offset by the plan, whose size the capacity bounds, not the rows."""
    before, total = {}, 0
    for n in sorted(counts):
        before[n] = total
        total += counts[n]
    spots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    base = 0
    for fill, times in plan:
        at = 0
        for n in fill:
            spots.setdefault(n, []).append((taken[n], base, at, times))
            taken[n] += times
            at += n
        base += times
    table = {n: np.array(x, np.int64) for n, x in spots.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for n, at in pdf.groupby("length").indices.items():
                t, rank = table[n], pdf["rank"].to_numpy()[at] - before[n]
                i = np.searchsorted(t[:, 0], rank, side="right") - 1
                seq[at], off[at] = t[i, 1] + rank - t[i, 0], t[i, 2]
            out = pdf.drop(columns=["rank"]).assign(sequence_id=seq, offset=off)
            yield out.astype({"doc_id": "Int64"})

    return pieces.mapInPandas(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 0, capacity: int = CAPACITY, order: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    With ``order``, a long column of docs, the pieces of each length are dealt to the fillings in that order, and
    sequences are numbered, from 0 without gaps, by the first place that they hold.
    """
    tmp = Scratch(docs.sparkSession, "packing")
    named = docs.select("doc_id", "text", (F.col(order) if order else F.lit(0)).cast("long").alias("place"))
    pieces = tmp.save(piece_table(named, tokenizer, kind, end_id, capacity).withColumn("one", F.lit(1).cast("long")), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = bin_completion(counts, capacity)
    ties = ("place", "doc_id", "row", "piece")
    numbered = ordered_prefix(pieces, "length", "one", "rank", tmp, ties=ties).drop("one")
    placed = place_pieces(numbered, plan, counts)
    if order:
        placed = tmp.save(placed, "placed")
        first = placed.groupBy("sequence_id").agg(F.min("place").alias("first")).withColumn("one", F.lit(1).cast("long"))
        first = ordered_prefix(first, "first", "one", "number", tmp, ties=("sequence_id",))
        placed = placed.join(first.select("sequence_id", "number"), "sequence_id").drop("sequence_id").withColumnRenamed("number", "sequence_id")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
