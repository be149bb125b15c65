"""Periodic runs of words: Lyndon roots by a stack from right to left under both orders of the words.

A run is a stretch of words with smallest period q that no neighbour extends; reported are runs of at least
``max(6, 4 * q)`` words. Every run holds a longest Lyndon word of length q under one of two opposite orders of the words
(a suffix that ends is the smaller one in both), so:

1. Words get numbers by their first place in the text; equal numbers are equal words, without hashing.
2. A run of four periods or more consists of places whose three words come three times or more in the text. Only
   stretches of at least four such places can hold one; most texts have none and are done. A run lies wholly in such a
   stretch together with what decides that it ends there, so the stretches are searched one by one.
3. In a stretch, the stack gives each place the next smaller suffix behind it. Suffixes are compared, and roots extended
   to both sides, by the longest common extension: a few words directly, then binary search over rolling hashes
   modulo 2 ** 61 - 1. An extension that is known one place further right at the same distance is carried on.
4. Each run found is verified word by word: that it repeats, and that the words beside it differ. A false one (equal
   hashes of different words) makes the stretch be searched again under another base.

There is no suffix array. A text is held whole in one task, with some 100 bytes for each word of it; texts are dealt as
they come, so no key gathers them. Null and empty texts have no words and no runs; a null doc_id means an unedited text;
repeated rows are rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST, TIMES = 6, 4
PRIME = (1 << 61) - 1
BASES = (0x1F3D5B79A2C4E687, 0x0B5A4C3D2E1F6079, 0x19E3779B97F4A7C1)
#: Words compared directly before hashes are asked; places between two extensions of one distance that are compared directly.
NEAR = 8


class Stretch:
    """Word numbers of a stretch with prefix hashes for longest common extensions."""

    def __init__(self, ids: list[int], base: int):
        self.ids, self.n = ids, len(ids)
        h, p = [0], [1]
        for x in ids:
            h.append((h[-1] * base + x + 1) % PRIME)
            p.append(p[-1] * base % PRIME)
        self.h, self.p = h, p
        self.known: dict[int, tuple[int, int]] = {}  # distance -> (place, extension)

    def same(self, i: int, j: int, m: int) -> bool:
        h, p = self.h, self.p[m]
        return (h[i + m] - h[i] * p - h[j + m] + h[j] * p) % PRIME == 0

    def forward(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        ids, most = self.ids, self.n - j
        m = 0
        while m < NEAR and m < most and ids[i + m] == ids[j + m]:
            m += 1
        if m < NEAR or m == most:
            return m
        at, extension = self.known.get(j - i, (-1, 0))
        if i <= at < i + NEAR:
            m = at - i + extension
        else:
            lo, hi = m, most  # lo words are equal
            step = NEAR
            while lo + step <= hi and self.same(i, j, lo + step):
                lo += step
                step *= 2
            hi = min(hi, lo + step - 1)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if self.same(i, j, mid) else (lo, mid - 1)
            m = lo
        self.known[j - i] = (i, m)
        return m

    def backward(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        ids, most = self.ids, i
        m = 0
        while m < NEAR and m < most and ids[i - m - 1] == ids[j - m - 1]:
            m += 1
        if m < NEAR or m == most:
            return m
        lo, hi = m, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.same(i - mid, j - mid, mid) else (lo, mid - 1)
        return lo


def _lyndon_runs(s: Stretch, falling: bool) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs whose roots are Lyndon words in the rising or falling order of the numbers."""
    ids, n = s.ids, s.n
    out: set[tuple[int, int, int]] = set()
    last: dict[int, tuple[int, int]] = {}  # period -> the run that was extended last
    stack = [n]
    for i in range(n - 1, -1, -1):
        x = ids[i]
        while (j := stack[-1]) < n:
            y = ids[j]
            if x == y:
                m = s.forward(i, j)
                if j + m == n:  # the suffix at j ends first
                    break
                x_, y_ = ids[i + m], ids[j + m]
            else:
                x_, y_ = x, y
            if (x_ > y_) != falling:
                break
            stack.pop()
        j = stack[-1]
        stack.append(i)
        q = j - i
        if TIMES * q > n or j == n or ids[i] != ids[j] and (not i or ids[i - 1] != ids[j - 1]):
            continue
        start, end = last.get(q, (n, n))
        if start <= i and j <= end:
            continue
        start, end = i - s.backward(i, j), j + s.forward(i, j)
        last[q] = (start, end)
        if end - start >= max(LEAST, TIMES * q):
            out.add((start, end - start, q))
    return out


def _verified(ids: list[int], run: tuple[int, int, int]) -> bool:
    """The run repeats word by word, and neither neighbour goes on with its period."""
    start, length, q = run
    end = start + length
    ends = (start == 0 or ids[start - 1] != ids[start - 1 + q]) and (end == len(ids) or ids[end] != ids[end - q])
    return ends and ids[start : end - q] == ids[start + q : end]


def stretch_runs(ids: list[int], bases: tuple[int, ...] = BASES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a list of word numbers, by start, then period."""
    for base in bases:
        s = Stretch(ids, base)
        found = _lyndon_runs(s, False) | _lyndon_runs(s, True)
        if all(_verified(ids, r) for r in found):
            return sorted(found, key=lambda r: (r[0], r[2]))
    raise ArithmeticError("rolling hashes of different words agree under every base")


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that can hold a run."""
    n = len(ids)
    if n < LEAST:
        return []
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        code = (x[:-2] * np.uint64(n) + x[1:-1]) * np.uint64(n) + x[2:]
    by = np.sort(code)
    often = np.unique(by[2:][by[2:] == by[:-2]])
    if not len(often):
        return []
    at = np.minimum(np.searchsorted(often, code), len(often) - 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], often[at] == code, [False]])))
    return [(a, b + 2) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= LEAST - 2]


def word_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period."""
    out = []
    for a, b in _stretches(ids):
        out += [(a + start, length, q) for start, length, q in stretch_runs(ids[a:b].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a stretch repeated, for a tenth of the documents; see the query's contract."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def _row(doc_id: int | None, text: str | None) -> dict:
    words = _repeated((text or "").encode().split(), doc_id)  # bytes.split() cuts at these six ASCII characters
    n = len(words)
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    runs = word_runs(ids)
    out = {"doc_id": doc_id, "n_runs": len(runs), "start": None, "length": None, "period": None, "exponent_milli": None}
    if runs:
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        out |= {"start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period}
        cover = np.zeros(n + 1, np.int64)
        for a, m, q in runs:
            cover[a + q] += 1
            cover[a + m] -= 1
        kept = np.cumsum(cover[:n]) == 0
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    out["runs_sha256"] = hashlib.sha256(listed.encode()).hexdigest()
    out["collapsed"] = b" ".join(words).decode()
    return out


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
        ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed", pa.string()),
    ]
)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed.

    collapsed is the text's words with each run cut to its first period, joined by a space.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(ids), 200):
                rows = [_row(d, t.as_py()) for d, t in zip(ids[i : i + 200], texts[i : i + 200], strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    kinds = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, kinds)
