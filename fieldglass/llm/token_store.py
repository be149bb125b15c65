"""A content-addressed store of token ids.

Rolling hashes cut each document's id stream into chunks where its content says so, so that equal passages give equal
chunks. Each distinct chunk is stored once under its digest; a document's recipe lists its chunks; Merkle manifests
cover the chunks of a document, the documents of a pack and the packs of a group.

Files, all Parquet below one folder: ``chunks/kind=0`` recipes as written (unordered), ``chunks/kind=1`` chunks (digest,
n, payload: the ids, little-endian), ``recipes`` in ascending doc_id order (doc_id, row, start, n_tokens, digests, root),
``manifest/packs`` (group, pack, start, documents, root) and ``manifest/groups`` (group, packs, root). A pack is the
documents that start within PACK ids, a group is GROUP packs.

Reading checks each payload against its digest, each recipe against its root, each pack against its documents and each
group against its packs, and gets a document's checksum by combining those of its chunks, so that payloads are never
shuffled on the way back. ``verified`` is false for a document if any of these fails on the way to it.

Null texts have the end id only; null doc_ids come first, in the order of their roots; a doc_id that comes twice has two
recipes, in the order of their roots; an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import Scratch, ordered_prefix
from .packing import with_end
from .tokens import encoder, parts, text_bytes

#: A chunk ends where the rolling hash of WINDOW ids has CUT_BITS leading zeros; ids in a chunk at most.
WINDOW, CUT_BITS, LONGEST = 16, 9, 4096
#: Ids in a pack of the manifest; packs in a group.
PACK, GROUP = 1 << 20, 4096
STORED = "kind int, key long, doc_id long, row long, n long, digests array<binary>, digest binary, payload binary"
_FIELDS = pa.schema(
    [
        ("kind", pa.int32()),
        ("key", pa.int64()),
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("n", pa.int64()),
        ("digests", pa.list_(pa.binary())),
        ("digest", pa.binary()),
        ("payload", pa.binary())
    ]
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut_points(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ends of all chunks of the id streams ids[at[i]:at[i + 1]]: where the hash of the WINDOW ids before says so.

    No hash reaches over a stream's start, so that a stream's chunks don't depend on its neighbours.
    """
    with np.errstate(over="ignore"):
        h = _mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        step, base = 1, np.uint64(0x9E3779B97F4A7C15 | 1)
        while step < WINDOW and step < len(h):  # h[i] covers twice as many ids ending at i after each turn
            h[step:] = h[step:] + h[:-step] * base
            step, base = 2 * step, base * base
        ends = np.flatnonzero((_mix(h) >> np.uint64(64 - CUT_BITS)) == 0) + 1
    stream = np.searchsorted(at, ends, side="left") - 1  # the stream that a chunk's last id is in
    ends = ends[ends - at[stream] >= WINDOW]
    ends = np.union1d(ends, at[1:][at[1:] > at[:-1]])
    sizes = np.diff(np.concatenate([[0], ends]))
    long = np.flatnonzero(sizes > LONGEST)
    if len(long):
        more = [np.arange(ends[i] - sizes[i] + LONGEST, ends[i], LONGEST) for i in long.tolist()]
        ends = np.union1d(ends, np.concatenate(more))
    return ends.astype(np.int64)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Binary Merkle root, leaves and nodes hashed apart; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def write_store(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int) -> None:
    """Tokenize docs(doc_id, text) into the store at path."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        seen: set[bytes] = set()  # of this task's recent chunks: most repeats don't leave the task

        for batch in batches:
            for some in parts(batch, "text"):
                wide, at = with_end(*enc.encode(*text_bytes(some.column("text"))), end_id)
                yield from _chunks(some.column("doc_id").cast(pa.int64()), some.column("row"), wide.astype(enc.dtype), at, seen)
                if len(seen) > 200_000:
                    seen.clear()

    made = rows.mapInArrow(chunked, STORED)
    last = F.lag("digest").over(W.partitionBy("kind", "key").orderBy("digest"))  # a key is a part of the digest: few rows have one
    once = made.withColumn("_last", last).filter((F.col("kind") == 0) | F.col("_last").isNull() | (F.col("_last") != F.col("digest")))
    once.drop("key", "_last").write.partitionBy("kind").option("compression", "lz4").parquet(f"{path}/chunks")

    rooted = _recipes_as_written(spark, path).withColumn("root", _root("digests"))
    tmp = Scratch(spark, "store")
    rooted = tmp.save(rooted, "recipes")
    started = ordered_prefix(rooted, "doc_id", "n_tokens", "start", tmp, ties=("root", "row"))
    started = started.select("doc_id", "row", F.col("start").cast("long").alias("start"), "n_tokens", "digests", "root")
    started.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    packs = tmp.save(pack_roots(_recipes(spark, path)), "packs")
    packs.write.parquet(f"{path}/manifest/packs")
    group_roots(packs).write.parquet(f"{path}/manifest/groups")
    tmp.drop(rooted, packs)


def _chunks(docs: pa.Array, rows: pa.Array, ids: np.ndarray, at: np.ndarray, seen: set[bytes]) -> Iterator[pa.RecordBatch]:
    """Recipes of the documents, and those of their chunks that are not in ``seen``, which gets them."""
    ends = cut_points(ids, at)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    raw, w = ids.tobytes(), ids.itemsize
    every, new = [], []
    for i, (x, y) in enumerate(zip((begins * w).tolist(), (ends * w).tolist(), strict=True)):
        every.append(d := _digest(raw[x:y]))
        if d not in seen:
            seen.add(d)
            new.append(i)
    digests, k, n = pa.array(every, pa.binary()), len(new), len(docs)
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(ends, at, side="right"), pa.int32()), digests)
    yield _stored(n, kind=pa.array(np.zeros(n, np.int32)), key=rows, doc_id=docs, row=rows, n=pa.array(np.diff(at)), digests=lists)
    size, start, first = (ends - begins)[new], begins[new] * w, np.zeros(k + 1, np.int32)
    np.cumsum(size * w, out=first[1:])
    payload = b"".join([raw[x : x + y] for x, y in zip(start.tolist(), (size * w).tolist(), strict=True)])
    payloads = pa.BinaryArray.from_buffers(pa.binary(), k, [None, pa.py_buffer(first), pa.py_buffer(payload)])
    mine = digests.take(pa.array(new, pa.int64()))
    key = np.frombuffer(b"".join(every[i][:8] for i in new), "<i8")
    yield _stored(k, kind=pa.array(np.ones(k, np.int32)), key=pa.array(key), n=pa.array(size), digest=mine, payload=payloads)


def _stored(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of the stored table, nulls where no column is given."""
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _FIELDS], schema=_FIELDS)


@F.pandas_udf(BinaryType())
def _root(digests: pd.Series) -> pd.Series:
    return digests.map(lambda x: merkle_root([bytes(d) for d in x]))


def _recipes_as_written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(f"{path}/chunks").filter("kind = 0").select("doc_id", "row", F.col("n").alias("n_tokens"), "digests")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, row long, start long, n_tokens long, digests array<binary>, root binary").parquet(f"{path}/recipes")


def pack_roots(recipes: DataFrame) -> DataFrame:
    """A row for each pack: the Merkle root over its documents' roots in order. A pack has PACK documents at most."""
    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        pack = int(pdf["pack"].iloc[0])
        root = merkle_root([bytes(x) for x in pdf["root"]])
        return pd.DataFrame(
            [(pack // GROUP, pack, int(pdf["start"].iloc[0]), len(pdf), root)],
            columns=["group", "pack", "start", "documents", "root"]
        )

    packed = recipes.select(F.floor(F.col("start") / PACK).alias("pack"), "start", "root")
    return packed.groupBy("pack").applyInPandas(cover, "group long, pack long, start long, documents long, root binary")


def group_roots(packs: DataFrame) -> DataFrame:
    """A row for each group: the Merkle root over its packs' roots in order. A group has GROUP packs at most."""
    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pack")
        root = merkle_root([bytes(x) for x in pdf["root"]])
        return pd.DataFrame([(int(pdf["group"].iloc[0]), len(pdf), root)], columns=["group", "packs", "root"])

    return packs.select("group", "pack", "root").groupBy("group").applyInPandas(cover, "group long, packs long, root binary")


def _shift(n: int) -> int:
    """x^(8 n) modulo the polynomial of CRC-32, reflected: what n more bytes multiply a checksum by."""
    out, square = 0x80000000, 0x00800000
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


def _times(a: int, b: int) -> int:
    out = 0
    for i in range(32):
        if a & (0x80000000 >> i):
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def combine_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from (checksum, bytes) of each part."""
    crc = 0
    for c, n in parts:
        crc = _times(_shift_of(n), crc) ^ c if crc else c
    return crc


_shifts: dict[int, int] = {}


def _shift_of(n: int) -> int:
    if n not in _shifts:
        if len(_shifts) > 100_000:
            _shifts.clear()
        _shifts[n] = _shift(n)
    return _shifts[n]


def read_store(spark: SparkSession, path: str, dtype: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified, from the store's files."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            crc = [zlib.crc32(np.frombuffer(p, dtype).astype("<u4").tobytes()) for p in pdf["payload"]]
            good = [_digest(bytes(p)) == bytes(d) for p, d in zip(pdf["payload"], pdf["digest"], strict=True)]
            yield pd.DataFrame(
                {"digest": pdf["digest"], "ids": [len(p) // np.dtype(dtype).itemsize for p in pdf["payload"]], "crc": crc, "good": good}
            )

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for parts in pdf["parts"]:
                parts = sorted(parts, key=lambda p: p["at"])
                good = all(p["good"] for p in parts) and [p["at"] for p in parts] == list(range(len(parts)))
                good = good and merkle_root([bytes(p["digest"]) for p in parts])
                there = [p for p in parts if p["crc"] is not None]
                out.append((combine_crc([(p["crc"], 4 * p["ids"]) for p in there]), sum(p["ids"] for p in there), good or b""))
            crc, n, root = zip(*out, strict=True) if out else ((), (), ())
            fits = [bytes(a) == bytes(b) for a, b in zip(root, pdf["root"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "start": pdf["start"], "n_tokens": n, "ids_crc32": crc, "verified": fits})

    chunks = spark.read.schema(STORED).parquet(f"{path}/chunks").filter("kind = 1")
    facts = chunks.select("digest", "payload").mapInPandas(sums, "digest binary, ids long, crc long, good boolean")
    recipes = _recipes(spark, path)
    lines = recipes.select("doc_id", "row", "start", "root", F.posexplode("digests").alias("at", "digest"))
    found = lines.join(facts, "digest", "left").groupBy("doc_id", "row", "start", "root")
    found = found.agg(F.collect_list(F.struct("at", "digest", "ids", "crc", "good")).alias("parts"))
    read = found.mapInPandas(whole, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")
    packs = spark.read.schema("group long, pack long, start long, documents long, root binary").parquet(f"{path}/manifest/packs")
    groups = spark.read.schema("group long, packs long, root binary").parquet(f"{path}/manifest/groups")
    fresh = pack_roots(recipes).select("pack", F.col("root").alias("found"))
    whole_groups = group_roots(packs).select("group", F.col("root").alias("found")).join(groups, "group").filter("found = root").select(
        "group",
        F.lit(True).alias("in_group")
    )
    sound = packs.join(fresh, "pack").filter("found = root").join(whole_groups, "group").select("pack", "in_group")
    read = read.withColumn("pack", F.floor(F.col("start") / PACK)).join(sound, "pack", "left")
    return read.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("verified") & F.coalesce("in_group", F.lit(False))).alias("verified"))


def store_documents(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2) -> DataFrame:
    """Write docs to a store in the shared folder, and read it back."""
    spark = docs.sparkSession
    path = Scratch(spark, "token-store").path("store")
    write_store(docs, path, tokenizer, kind, end_id)
    return read_store(spark, path)
