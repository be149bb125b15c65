"""Removal of repeated substrings by suffix arrays.

A string of ``length`` bytes that starts at two places, in one document or two, is a repeat; every byte that a repeat
covers is removed.

1. Candidates. Each window of ``length`` bytes has a key: the least hash of its ANCHOR-byte strings. Equal windows have
   equal keys, and neighbouring windows mostly share theirs; a run of windows with one key is a stretch. A stretch
   whose key occurs nowhere else can't hold a repeat.
2. Shards. The other stretches' bytes go to shards by key, so that windows that could be equal meet; equal stretches
   are one entry with the number of times it comes. A key with more bytes than a shard holds is dealt to shards of its
   own.
3. Each shard sorts all suffixes of its stretches by Larsson-Sadakane refinement in numpy, and Kasai's algorithm gives
   the common prefixes of neighbours. Windows in a run of common prefixes of ``length`` or more are repeats.
4. Merging. The windows of a key that was dealt to several shards are looked up among the other shards' by binary
   search: shards give their windows as sorted digests, cut into ranges, and each range searches its lists.
5. Repeats go back to their documents, where overlapping ones become spans.

Null texts are empty; texts shorter than ``length`` lose nothing; a doc_id that comes twice is two texts (which repeat
each other if equal); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .shingles import mix

#: Bytes of the strings whose hashes make keys; bytes in a shard, about; windows of a stretch at most.
ANCHOR, SHARD, STRETCH = 56, 2_000_000, 4096
_RNG = np.random.default_rng(0x5A)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
END = 0xFF  # never occurs in UTF-8


def rolling(b: np.ndarray, width: int) -> np.ndarray:
    """A hash of each string of ``width`` bytes: windows are doubled, then joined."""
    with np.errstate(over="ignore"):
        power, have, at = {1: _BYTE[b]}, 1, 0
        while have * 2 <= width:
            h = power[have]
            power[have * 2] = h[:-have] * np.uint64(pow(_BASE, have, 2**64)) + h[have:] if len(h) > have else h[:0]
            have *= 2
        out = None
        n = len(b) - width + 1
        while have:
            if width & have:
                part = power[have][at : at + n]
                out = part.copy() if out is None else out * np.uint64(pow(_BASE, have, 2**64)) + part
                at += have
            have >>= 1
    return mix(out)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have, m = 1, h
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - have :]) if have < width else m


def stretches(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window, windows and whether the key comes at two places inside, for each stretch of a text."""
    if len(b) < length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z.astype(bool)
    width = length - ANCHOR + 1
    h = rolling(b, ANCHOR)
    m = sliding_min(h, width)
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    count = np.diff(np.append(first, len(m)))
    if (count > STRETCH).any():
        first = np.unique(
            np.concatenate([first, *[np.arange(f, f + c, STRETCH) for f, c in zip(first[count > STRETCH], count[count > STRETCH], strict=True)]])
        )
        count = np.diff(np.append(first, len(m)))
    key = m[first]
    # The key's places: the first in the first window, the last in the last window.
    left = np.zeros(len(first), np.int64)
    right = np.zeros(len(first), np.int64)
    for at in range(0, len(first), 4096):
        f, c, k = first[at : at + 4096], count[at : at + 4096], key[at : at + 4096, None]
        span = np.arange(width)
        left[at : at + 4096] = f + (h[f[:, None] + span] == k).argmax(1)
        right[at : at + 4096] = f + c - 1 + width - 1 - (h[(f + c - 1)[:, None] + span[::-1]] == k).argmax(1)
    return key, first, count, left != right


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes.

    Larsson and Sadakane: ranks by h bytes order the suffixes by 2 h bytes, and only groups that are still tied are
    sorted again.
    """
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for j in range(8):
        first = (first << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(first, kind="stable")
    new = np.concatenate([[True], first[order[1:]] != first[order[:-1]]])
    group = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank is its first place
    rank = np.zeros(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    h = 8
    while True:
        tied = np.zeros(n, bool)
        same = ~new[1:]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        pos = order[at]
        second = rank[np.minimum(pos + h, n)] + 1
        by = np.argsort((rank[pos].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), kind="stable")
        pos, second = pos[by], second[by]
        order[at] = pos
        mine = rank[pos]
        fresh = np.concatenate([[True], (mine[1:] != mine[:-1]) | (second[1:] != second[:-1])])
        new[at] = fresh
        rank[pos] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        h *= 2
    return order


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int, lanes: int = 64) -> np.ndarray:
    """For each place in the order but the first: bytes in common with the suffix before, up to ``depth``.

    Kasai: the next position's common prefix is at least this one's less one. Runs of ``lanes`` positions go through
    the text side by side, each with the algorithm's single counter.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([t, np.full(depth + 8, END, np.uint8)])
    limit = np.minimum(depth, n)
    known = np.zeros(n, np.int64)
    starts = np.arange(0, n, lanes)
    held = np.zeros(len(starts), np.int64)
    for j in range(lanes):
        p = starts + j
        p = p[p < n]
        q = before[p]
        k = np.where(q >= 0, np.maximum(held[: len(p)] - 1, 0), 0)
        live = np.flatnonzero((q >= 0) & (k < limit))
        while len(live):
            a, b, k0 = p[live], q[live], k[live]
            fits = (np.maximum(a, b) + k0 < n) & (padded[a + k0] == padded[b + k0])
            live = live[fits]
            k[live] += 1
            live = live[k[live] < limit]
        known[p] = k
        held = k
    return known[order[1:]]


def repeated_windows(parts: list[bytes], times: np.ndarray, length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each part: which of its windows are repeats within the parts, and the offsets of one window of each class.

    The classes come in suffix order; ``times`` counts how often a part comes, so that a part that comes twice repeats.
    """
    sizes = np.array([len(p) for p in parts])
    t = np.frombuffer(bytes([END]).join(parts) + bytes([END]), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    whole = np.zeros(len(t), bool)  # a window starts here and ends inside its part
    for b, n in zip(begin, sizes, strict=True):
        whole[b : b + n - length + 1] = True
    order = suffix_array(t)
    lcp = common_prefixes(t, order, length)
    tie = lcp >= length
    cls = np.cumsum(np.concatenate([[True], ~tie])) - 1
    keep = whole[order]
    pos, cls = order[keep], cls[keep]
    count = np.bincount(cls, weights=times[part[pos]].astype(float))
    again = np.zeros(len(t), bool)
    again[pos[count[cls] > 1]] = True
    one = np.zeros(len(t), bool)
    one[pos[np.concatenate([[True], cls[1:] != cls[:-1]])]] = True if len(pos) else False
    flags = [again[b : b + n - length + 1] for b, n in zip(begin, sizes, strict=True)]
    return flags, [np.flatnonzero(one[b : b + n - length + 1]) for b, n in zip(begin, sizes, strict=True)]


def _spans(flags: np.ndarray, length: int) -> np.ndarray:
    """Byte spans (start, end) that the flagged windows cover."""
    at = np.flatnonzero(flags)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(at) > length)
    return np.stack([at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + length], 1)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Ascending, disjoint spans; touching ones become one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain)."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "suffix")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Equal texts are one text that comes so many times.
    hashed = base.withColumn("id", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)))
    texts = tmp.save_bucketed(hashed.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.min("text").alias("text")), "texts", "id")
    tmp.settle()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, times in zip(pdf["id"], pdf["text"], pdf["times"], strict=True):
                key, first, count, inner = stretches(np.frombuffer(text.encode(), np.uint8), length)
                if len(key):
                    out.append(
                        (
                            i,
                            key.astype(np.int64),
                            first.astype(np.int32),
                            count.astype(np.int32),
                            np.where(inner | (times > 1), 2, 1).astype(np.int32)
                        )
                    )
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=["id", "key", "first", "count", "places"])
                    out = []
            yield pd.DataFrame(out, columns=["id", "key", "first", "count", "places"])

    rows = texts.select("id", "text", "times").mapInPandas(scan, "id binary, key array<long>, first array<int>, count array<int>, places array<int>")
    rows = rows.select("id", F.explode(F.arrays_zip("key", "first", "count", "places")).alias("x")).select("id", "x.*")
    rows = tmp.save(rows, "stretches")
    often = rows.groupBy("key").agg(F.sum("places").alias("n"), F.sum(F.col("count") + (length - 1)).alias("bytes")).filter("n > 1")
    often = tmp.save(often, "keys")
    tmp.settle()
    total, largest = often.agg(F.sum("bytes"), F.max("bytes")).first()
    total, largest = total or 0, largest or 0
    digits = 1 if largest <= 256 * SHARD else 2 if largest <= 65536 * SHARD else 3  # bytes of a digest that name its range
    shards = max(1, math.ceil(total / SHARD))
    wanted = tmp.save(
        rows.join(often.select("key"), "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("first", "count", "key"))).alias("parts")),
        "wanted"
    )
    tmp.drop(rows)
    del rows
    tmp.settle()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, times, parts in zip(pdf["id"], pdf["text"], pdf["times"], pdf["parts"], strict=True):
                raw = text.encode()
                for p in parts:
                    data = raw[p["first"] : p["first"] + p["count"] + length - 1]
                    out.append((p["key"], hashlib.blake2b(data, digest_size=16).digest(), data, times, i, p["first"]))
                    if len(out) >= 20000:
                        yield pd.DataFrame(out, columns=["key", "digest", "data", "times", "id", "first"])
                        out = []
            yield pd.DataFrame(out, columns=["key", "digest", "data", "times", "id", "first"])

    taken = texts.select("id", "text", "times").join(wanted, "id").mapInPandas(
        cut,
        "key long, digest binary, data binary, times long, id binary, first int"
    )
    taken = tmp.save(taken, "taken", "zstd")
    tmp.drop(wanted)
    del wanted
    tmp.settle()
    entries = taken.groupBy("key", "digest").agg(F.sum("times").alias("times"), F.first("data").alias("data"))
    # Keys with more bytes than a shard take shards of their own, numbered from -1 down by hash.
    heavy = often.filter(F.col("bytes") > SHARD // 2).select("key", F.ceil(F.col("bytes") / (SHARD // 2)).cast("int").alias("pieces"))
    dealt = entries.join(heavy, "key", "left")
    own = F.pmod(F.xxhash64("digest"), F.coalesce("pieces", F.lit(1)))
    dealt = dealt.withColumn("shard", F.when(F.col("pieces") > 1, F.xxhash64("key", own)).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [bytes(x) for x in pdf["data"]]
        flags, ones = repeated_windows(parts, pdf["times"].to_numpy(), length)
        out = []
        for key, digest, pieces, data, f, one in zip(pdf["key"], pdf["digest"], pdf["pieces"], parts, flags, ones, strict=True):
            found = None
            if pieces == pieces and pieces is not None and pieces > 1:  # classes, for the other shards of the key
                found = b"".join(hashlib.blake2b(data[o : o + length], digest_size=12).digest() + int(o).to_bytes(4, "little") for o in one.tolist())
            out.append((key, digest, np.packbits(f).tobytes(), found))
        return pd.DataFrame(out, columns=["key", "digest", "flags", "classes"])

    found = dealt.select("shard", "key", "digest", "times", "pieces", "data").groupBy("shard").applyInPandas(
        search,
        "key long, digest binary, flags binary, classes binary"
    )
    found = tmp.save(found, "found")
    del entries, dealt
    tmp.settle()

    def by_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Classes of each entry, sorted, cut into ranges of the digest."""
        for pdf in batches:
            out = []
            for key, digest, classes in zip(pdf["key"], pdf["digest"], pdf["classes"], strict=True):
                raw = np.frombuffer(classes, np.uint8).reshape(-1, 16)
                of = raw[:, :digits].astype(np.int64) @ (256 ** np.arange(digits))
                for r in np.unique(of).tolist():
                    out.append((key, r, digest, raw[of == r].tobytes()))
            yield pd.DataFrame(out, columns=["key", "range", "digest", "classes"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Classes that entries of two shards have, by binary search of each entry's sorted list in the joint list."""
        lists = [np.frombuffer(x, np.uint8).reshape(-1, 16) for x in pdf["classes"]]
        codes = [np.ascontiguousarray(x[:, :12]).view("S12").ravel() for x in lists]
        every = np.sort(np.concatenate(codes))
        out = []
        for digest, key, x, c in zip(pdf["digest"], pdf["key"], lists, codes, strict=True):
            more = np.searchsorted(every, c, "right") - np.searchsorted(every, c, "left") > 1
            if more.any():
                out.append((key, digest, np.ascontiguousarray(x[more, 12:]).view("<u4").ravel().astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["key", "digest", "more"])

    split = found.filter("classes IS NOT NULL").mapInPandas(by_range, "key long, range int, digest binary, classes binary")
    across = split.groupBy("key", "range").applyInPandas(merge, "key long, digest binary, more binary")
    across = across.groupBy("key", "digest").agg(F.collect_list("more").alias("more"))
    whole = found.select("key", "digest", "flags").join(across, ["key", "digest"], "left")
    placed = taken.select("key", "digest", "id", "first", F.octet_length("data").alias("size")).join(whole, ["key", "digest"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, first, size, flags, more in zip(pdf["id"], pdf["first"], pdf["size"], pdf["flags"], pdf["more"], strict=True):
                f = np.unpackbits(np.frombuffer(flags, np.uint8))[: size - length + 1]
                for m in more if more is not None else []:
                    f[np.frombuffer(m, "<u4")] = 1
                s = _spans(f, length)
                if len(s):
                    out.append((i, (s + first).astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["id", "spans"])

    spans = placed.select(
        "id",
        "first",
        "size",
        "flags",
        "more"
    ).mapInPandas(place, "id binary, spans binary").groupBy("id").agg(F.collect_list("spans").alias("spans"))
    spans = tmp.save(spans, "spans")
    tmp.drop(taken, found, often)
    del taken, found, often, split, across, whole, placed
    tmp.settle()

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, spans in zip(pdf["id"], pdf["text"], pdf["spans"], strict=True):
                raw = text.encode()
                s = _merged(np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in spans])) if spans is not None else []
                kept, last = [], 0
                for a, b in s:
                    kept.append(raw[last:a])
                    last = b
                kept = b"".join([*kept, raw[last:]])
                out.append((i, len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = texts.join(spans, "id", "left").select("id", "text", "spans")
    done = done.mapInPandas(rest, "id binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return hashed.select("doc_id", "id").join(done, "id").drop("id")
