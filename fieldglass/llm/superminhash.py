"""Near-duplicates by SuperMinHash signatures, banding, verification and grouping.

1. Each text becomes the set of its word shingles, as 64-bit hashes. Sets that are equal are one node.
2. Each element of a set draws a random permutation of the signature's slots, step by step, and a random fraction for
   each step; a slot keeps the least (step + fraction) that any element offers it. As the elements' ranks in a slot are
   spread evenly over the steps, signatures vary less than with independent hashes. Once every slot holds less than the
   next step, no element can lower any and the set is done (early stopping): long sets take a step or two. The sets of
   a batch go through the steps together.
3. A signature of ``BANDS`` times ``ROWS`` slots is cut into bands; sets that agree in a band share a bucket. Two sets of
   similarity 0.85 miss each other in all 36 bands with probability (1 - 0.85 ** 7) ** 36, one in a million.
4. Nodes with more shingles of their own than the threshold leaves out drop out. The others of a bucket are compared
   with a few pivots a round, more in each, the middle of a group first; members whose label shows that they are
   connected already aren't compared, and a bucket is done once all its members are pivots or of one label: no cap on
   candidates, and no list of all pairs. Candidates are held against four bits of each slot (a pair at the threshold
   fails there once in some ten million), then the overlap is counted on the full sets.
5. Components are found from all links by rounds of moving each node to the least in reach, a union-find in joins.

Texts without words (null, empty, white space) have empty sets and link with nothing; a text with fewer words than a
shingle is one shingle; a doc_id that comes twice counts as two texts; a component's id is its smallest doc_id that is
not null, and of a component without one all rows are kept; very long texts are taken whole, a set in one task; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components
from .jaccard import grouped, neighbour_labels
from .shingles import mix, shingle_set

BANDS, ROWS = 36, 7
#: Shingles that go through the steps together.
BATCH = 50_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def signatures(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``slots`` numbers (step in the high half, fraction in the low one) for each set; at most 256 slots."""
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    x = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
    each = np.arange(len(x))
    for k in range(slots):
        with np.errstate(over="ignore"):
            u = mix(x + _STEP * np.uint64(k + 1))
        j = k + ((u >> _HALF) * np.uint64(slots - k) >> _HALF).astype(np.int64)
        slot = order[each, j]
        order[each, j] = order[each, k]
        np.minimum.at(out.reshape(-1), owner * slots + slot, (np.uint64(k) << _HALF) | (u & _LOW))
        going = (out.max(axis=1) >> _HALF) > k  # a slot may still be lowered by a later step
        keep = going[owner]
        if not keep.any():
            break
        if not keep.all():
            x, owner, order = x[keep], owner[keep], order[keep]
            each = each[: len(x)]
    return out


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of each signature, different for equal bands in different places."""
    with np.errstate(over="ignore"):
        parts = sig.reshape(len(sig), -1, rows)
        h = np.tile(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), (len(sig), 1))
        for i in range(rows):
            h = mix(h * _STEP + parts[:, :, i])
    return h.view(np.int64)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _members(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row, n, key, tag, bands, bits: a row for each document; bands and bits are given once for a key and task, else null."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        rows: list[list] = []
        sets: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal size
            if sets:
                sig = signatures([s for _, s in sets])
                for (i, _), bands, bits in zip(sets, band_hashes(sig), _slot_bits(sig), strict=True):
                    rows[i][5:] = bands, bits
            out = pd.DataFrame(rows, columns=["doc_id", "row", "n", "key", "tag", "bands", "bits"]).astype({"doc_id": "Int64"})
            rows.clear(), sets.clear()
            size = 0
            return out

        for pdf in batches:
            for doc, row, tag, text in zip(pdf["doc_id"], pdf["row"], pdf["tag"], pdf["text"], strict=True):
                s = shingle_set(text, k)
                key = _key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    sets.append((len(rows), s))
                    size += len(s)
                rows.append([doc, row, len(s), key, tag, None, None])
                if size >= BATCH:
                    yield flush()
            if len(rows) >= 5000:
                yield flush()
        yield flush()

    rows = docs.select("doc_id", "tag", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInPandas(run, "doc_id long, row long, n int, key binary, tag binary, bands array<long>, bits array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """key, set: the shingles of each set, once for a key and task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for pdf in batches:
            out: list[tuple] = []
            size = 0
            for text in pdf["text"]:
                s = shingle_set(text, k)
                key = _key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    out.append((key, s.view(np.int64)))
                    size += len(s)
                if size >= 20 * BATCH:
                    yield pd.DataFrame(out, columns=["key", "set"])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=["key", "set"])

    return docs.select("text").mapInPandas(run, "key binary, set array<long>")


def _slot_bits(sig: np.ndarray) -> np.ndarray:
    """Four bits of each slot's hash, packed into longs."""
    four = (mix(sig) & np.uint64(15)).reshape(len(sig), -1)
    four = np.pad(four, ((0, 0), (0, -four.shape[1] % 16))).reshape(len(sig), -1, 16)
    return (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _most_apart(num: int, den: int, slots: int = BANDS * ROWS, deviations: float = 5.5) -> int:
    """How many slots' bits may differ: at the threshold, a pair differs in more once in some ten million."""
    q = (1 - num / den) * 15 / 16
    return int(slots * q + deviations * (slots * q * (1 - q)) ** 0.5)


def _apart(a: str, b: str) -> Column:
    """In how many slots the bits of two signatures differ."""
    out = F.lit(0)
    for i in range(-(-BANDS * ROWS // 16)):
        x = F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        out = out + F.bit_count(x)
    return out


def _possible(buckets: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of buckets with ``r``, without the nodes that can't reach the threshold with any, and without buckets of one.

    A shingle that no other node of a bucket has can't overlap anything; r, how many others a set has, bounds its
    overlap with any other.
    """
    shingle = sets.select("node", F.explode("set").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    alone = shingle.filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    left = buckets.join(alone, "node", "left").withColumn("r", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    left = left.filter(den * F.col("r") >= num * F.col("n"))
    common = left.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return left.join(common, "token")


def _linked(buckets: DataFrame, sets: DataFrame, num: int, den: int, tmp: Scratch) -> DataFrame | None:
    """(node, component) of the nodes that links connect with a smaller one; null where no bucket holds two nodes.

    Each round compares a bucket's members with its pivots of other labels; a pivot is then done. First comes the member
    with the fullest buckets, the middle of a group of copies; later pivots are members outside the bucket's most
    frequent label, sixteen times as many each round. A pair is compared in the first band that it agrees in only, and
    only if its signatures' bits differ in few slots.
    """
    most = _most_apart(num, den)
    links = tmp.save(buckets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), "links")
    open_, labels, pivots = buckets.withColumns({"label": F.col("node"), "outside": F.lit(True)}), None, 1
    while not open_.isEmpty():
        salted = open_.filter("outside").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(pivots)))
        lead = salted.groupBy("token", "salt").agg(F.max(F.struct("full", "node")).alias("p")).select("token", F.col("p.node").alias("node"), F.lit(True).alias("pivot"))
        now = tmp.save(open_.join(lead, ["token", "node"], "left").withColumn("pivot", F.coalesce("pivot", F.lit(False))), "buckets")
        m, p = now.alias("m"), now.filter("pivot").alias("p")
        overlap = F.least(F.col("m.r"), F.col("p.r"))
        fits = den * overlap >= num * (F.col("m.n") + F.col("p.n") - overlap)
        once = ~F.col("m.pivot") | (F.col("m.node") < F.col("p.node"))
        before = lambda s: F.slice(F.col(f"{s}.bands"), F.lit(1), F.col(f"{s}.band"))
        earlier = F.exists(F.zip_with(before("m"), before("p"), lambda x, y: x == y), lambda x: x)
        on = (F.col("m.token") == F.col("p.token")) & (F.col("m.label") != F.col("p.label")) & fits & once
        pairs = m.join(p, on & (_apart("m", "p") <= most) & ~earlier)
        pairs = tmp.save(pairs.select(F.col("m.node").alias("a"), F.col("p.node").alias("b"), F.col("m.n").alias("na"), F.col("p.n").alias("nb")), "pairs")
        side = lambda s: sets.select(F.col("node").alias(s), F.col("set").alias(f"s{s}"))
        both = F.size(F.array_intersect("sa", "sb"))
        found = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
        found = found.filter(den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")
        links = links.unionAll(tmp.save(found, "links"))
        labels = tmp.save(neighbour_labels(links, neighbour_labels(links, labels)), "labels")
        left = now.filter("NOT pivot").drop("label", "outside", "pivot").join(labels, "node", "left")
        left = left.withColumn("label", F.coalesce("label", "node"))
        each = left.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
        main = each.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
        left = left.join(main.select("token", F.col("m.label").alias("main")), "token")
        last, open_ = now, tmp.save(left.withColumn("outside", F.col("label") != F.col("main")).drop("main"), "open")
        tmp.drop(last)
        tmp.settle()
        pivots *= 16
    return None if labels is None else tmp.save(connected_components(links, tmp), "components")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), tag: Column | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, component, tag, kept: groups linked at the threshold.

    component_id is the smallest doc_id of a group (its own for a document without words), component a number that its
    rows share (null without words), kept whether the document is its group's; tag is a binary column that is handed on.
    """
    spark, (num, den) = docs.sparkSession, threshold
    tmp = Scratch(spark, "superminhash")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.lit(None) if tag is None else tag).cast("binary").alias("tag"))
    members = tmp.save(_members(docs, k), "members")
    first = F.min(F.struct("row", "n", "bands", "bits")).alias("x")
    nodes = members.filter("bands IS NOT NULL").groupBy("key").agg(first).select("key", F.col("x.row").alias("node"), "x.n", "x.bands", "x.bits")
    nodes = tmp.save(nodes, "nodes")
    tokens = nodes.select("node", "n", F.posexplode("bands").alias("band", "token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    buckets = tmp.save(tokens.join(common, "token"), "shared")
    busy = nodes.select("key", "node").join(buckets.select("node").distinct(), "node")
    sets = tmp.save(_sets(docs, k).join(busy, "key").select("node", "set").dropDuplicates(["node"]), "sets")
    tmp.settle()
    buckets = tmp.save(_possible(buckets.drop("c"), sets, num, den), "possible")
    marks = buckets.groupBy("node").agg(F.sum("c").alias("full")).join(nodes.select("node", "bands", "bits"), "node")
    buckets = tmp.save(buckets.drop("c").join(marks, "node"), "buckets")
    tmp.drop(nodes)
    tmp.settle()
    comps = _linked(buckets, sets, num, den, tmp)
    out = grouped(members.drop("bands", "bits"), comps, tmp)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
