"""N-gram Jaccard join with vertical partitioning.

1. Each text becomes the set of its word shingles, as hashes. The hash order is cut into fragments; a fragment gathers
   its part of all sets and tells which shingles occur in two documents or more, and in how many. Other shingles can't
   overlap anything and only count towards set sizes.
2. Equal sets become one node. A node's shared shingles are put into the global order, rarest first; two sets that
   reach the threshold share one among the first few of each (prefix filter). A bucket holds the nodes with one prefix
   shingle, each with the number of shared shingles that stand from there on: the first shingle that two sets have in
   common bounds their overlap by the smaller of these numbers (position filter), and every linked pair passes there.
   Buckets with the same nodes, as the shingles of a shared passage have, are made one.
3. Nodes of a bucket are compared without listing all their pairs: each bucket compares its members with a few pivots a
   round, more in each; a pivot is then done. Links carry labels on, so that nodes of one label are connected and need
   no comparison with each other. After a round, a member stays only if the bounds of the bucket's other labels leave
   it a partner. A bucket is done once all its members are pivots or of one label, so no link between different
   components is missed and no partner or candidate is capped. Components are found from all links at the end.
4. A pair is compared by its fragments: each counts the partial overlap of the two sets' segments, and the sums per pair
   decide. Every accepted pair is exact but for 46-bit hash collisions within a pair.

Texts without words (null, empty, white space) have empty sets and link with nothing; a doc_id that comes twice counts
as two texts; component ids are by the smallest doc_id that is not null (null if there is none); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components
from .shingles import shingle_set

#: Hashes gathered in a task before they are sent on; hashes that a fragment holds, about. Both are held in a worker's
#: memory. A lot sends a row to each fragment that it has hashes for, never more rows than hashes.
LOT, FRAGMENT = 500_000, 1_000_000
#: Fragments in which a pair is compared, as bits of the hash.
PAIR_BITS, HASH_BITS = 2, 46
MANY = np.uint32(0xFFFFFFFF)
_LOTS = "kind int, deal long, fragment int, lot long, row long, doc_id long, n int, key binary, tokens binary, who binary, times binary"


def _sets(docs: DataFrame, k: int, fragments: int) -> DataFrame:
    """kind 0: a row for each document, its tag as tokens; kind 1: a lot's set with its locally shared hashes; kind 2: what a fragment tells a lot.

    Tasks send each fragment its hashes of a lot, with who has them: the number of the lot's set, or MANY if several
    have it. A fragment answers with the hashes that two sets or more have, and in how many (``times``).
    """
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: list[np.ndarray] = []
        heads: list[tuple[int, int, bytes]] = []
        seen: set[bytes] = set()
        size = 0

        def flush() -> pd.DataFrame | None:
            if not sets:
                return None
            lot = heads[0][0]
            tokens = np.concatenate(sets)
            who = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            order = np.argsort(tokens, kind="stable")
            tokens, who = tokens[order], who[order]
            at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            times = np.diff(np.append(at, len(tokens))).astype(np.uint32)
            inner = np.repeat(times > 1, times)
            out, one = [], who[inner]
            kept, by = tokens[inner], np.argsort(one, kind="stable")
            ends = np.searchsorted(one[by], np.arange(len(sets) + 1))
            for i, (row, n, key) in enumerate(heads):
                out.append((1, row, -1, lot, row, None, n, key, _pack(kept[by[ends[i] : ends[i + 1]]]), np.uint32(i).tobytes(), None))
            first = np.where(times > 1, MANY, who[at])
            tokens = tokens[at]
            parts = (tokens >> np.uint64(HASH_BITS - 32)) * np.uint64(fragments) >> np.uint64(32)
            cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]])).tolist()
            for a, b in itertools.pairwise(cuts):
                f = int(parts[a])
                out.append((2, -1 - f, f, lot, None, None, None, None, _pack(tokens[a:b]), _planes(first[a:b]), _planes(times[a:b])))
            sets.clear(), heads.clear(), seen.clear()
            return _lots(out)

        for pdf in batches:
            out = []
            for doc, row, tag, text in zip(pdf["doc_id"], pdf["row"], pdf["tag"], pdf["text"], strict=True):
                s = shingle_set(text, k)
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                out.append((0, row, -1, None, row, doc, len(s), key, tag, None, None))
                if len(s) and key not in seen:
                    seen.add(key)
                    s = np.unique(s >> np.uint64(64 - HASH_BITS))
                    sets.append(s)
                    heads.append((row, len(s), key))
                    size += len(s)
                    if size >= LOT:
                        yield flush()
                        size = 0
            yield _lots(out)
        last = flush()
        if last is not None:
            yield last

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by fragment: the rows of each are gathered, merged and answered; other rows pass."""
        held: list[pd.DataFrame] = []
        for pdf in batches:
            sent = pdf["kind"] == 2
            yield pdf[~sent]
            for f, part in pdf[sent].groupby("fragment"):
                if held and held[0]["fragment"].iloc[0] != f:
                    yield _merge(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield _merge(pd.concat(held))

    rows = docs.select("doc_id", "tag", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    made = rows.mapInPandas(gather, _LOTS)
    return made.repartition("deal").sortWithinPartitions("kind", "fragment").mapInPandas(answer, _LOTS).drop("deal", "fragment")


def _merge(sent: pd.DataFrame) -> pd.DataFrame:
    """For each lot: its hashes of the fragment that two sets or more have, with who has them and in how many sets."""
    tokens = [_unpack(x) for x in sent["tokens"]]
    times = np.concatenate([_flat(x) for x in sent["times"]]).astype(np.int64)
    _, at = np.unique(np.concatenate(tokens), return_inverse=True)
    df = np.minimum(np.bincount(at, weights=times), 2**32 - 1).astype(np.uint32)[at]
    out, i = [], 0
    for lot, t, who in zip(sent["lot"], tokens, sent["who"], strict=True):
        d = df[i : i + len(t)]
        i += len(t)
        keep = d > 1
        if keep.any():
            out.append((2, -1, -1, lot, None, None, None, None, _pack(t[keep]), _planes(_flat(who)[keep]), _planes(d[keep])))
    return _lots(out)


def _lots(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["kind", "deal", "fragment", "lot", "row", "doc_id", "n", "key", "tokens", "who", "times"])
    return made.astype({"lot": "Int64", "row": "Int64", "doc_id": "Int64", "n": "Int32"})


def _pack(tokens: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte planes apart, so that the shuffle's compression finds their zeros."""
    import zstandard

    gaps = np.diff(tokens, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed: high bytes are mostly alike."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _flat(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _nodes(lots: DataFrame, num: int, den: int) -> DataFrame:
    """row, n, key, tokens: each lot's sets that could reach the threshold, with their shared hashes, rarest first."""
    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 2]
        if not len(ours):
            return pd.DataFrame([], columns=["row", "n", "key", "tokens"])
        tokens = np.concatenate([np.zeros(0, np.uint64), *[_unpack(x) for x in theirs["tokens"]]])
        who = np.concatenate([np.zeros(0, np.uint32), *[_flat(x) for x in theirs["who"]]])
        df = np.concatenate([np.zeros(0, np.uint32), *[_flat(x) for x in theirs["times"]]])
        one = np.flatnonzero(who != MANY)
        one = one[np.argsort(who[one], kind="stable")]
        ends = np.searchsorted(who[one], np.arange(len(ours) + 2))
        by = np.argsort(tokens, kind="stable")
        tokens_in, df_in = tokens[by], df[by]
        out = []
        for row, n, key, raw, i in zip(ours["row"], ours["n"], ours["key"], ours["tokens"], ours["who"], strict=True):
            i = int(np.frombuffer(i, np.uint32)[0])
            local = _unpack(raw)
            mine = one[ends[i] : ends[i + 1]]
            t = np.concatenate([local, tokens[mine]])
            if den * len(t) < num * n:
                continue
            d = np.concatenate([df_in[np.searchsorted(tokens_in, local)], df[mine]])
            out.append((row, n, key, t[np.lexsort((t, d))].astype(np.int64)))
        return pd.DataFrame(out, columns=["row", "n", "key", "tokens"])

    sent = lots.filter("kind > 0").select("kind", "lot", "row", "n", "key", "tokens", "who", "times")
    return sent.groupBy("lot").applyInPandas(finish, "row long, n int, key binary, tokens array<long>")


def _verify(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose sets reach the threshold: partial overlaps of their segments, summed per pair."""
    parts = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(2**PAIR_BITS - 1))))
    parts = parts.join(segments.select(F.col("node").alias("a"), "fragment", F.col("segment").alias("sa")), ["a", "fragment"])
    parts = parts.join(segments.select(F.col("node").alias("b"), "fragment", F.col("segment").alias("sb")), ["b", "fragment"])
    sums = parts.withColumn("_part", F.size(F.array_intersect("sa", "sb"))).groupBy("a", "b", "na", "nb").agg(F.sum("_part").alias("both"))
    return sums.filter(den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _merged_buckets(buckets: DataFrame) -> DataFrame:
    """buckets(token, node, n, r) with those of the same nodes made one, as the shingles of a shared passage are.

    The first of their shingles in the global order is the same for all nodes; what stands from there on bounds overlaps.
    """
    sums = (F.bit_xor(F.xxhash64("node")), F.sum(F.shiftright(F.xxhash64(F.lit(7), "node"), 24)))
    each = buckets.groupBy("token").agg(F.count(F.lit(1)).alias("c"), *[s.alias(c) for s, c in zip(sums, "xy", strict=True)])
    same = each.groupBy("c", "x", "y").agg(F.min("token").alias("bucket"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    moved = each.join(same, ["c", "x", "y"]).select("token", "bucket")
    at = buckets.join(moved, "token", "left").withColumn("token", F.coalesce("bucket", "token"))
    return at.groupBy("token", "node", "n").agg(F.max("r").alias("r")).select("token", "node", "n", "r")


def _candidates(members: DataFrame, lead: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, na, nb), a < b: members of a bucket with its pivots of other components, where sizes and positions allow a link."""
    m, p = members.alias("m"), lead.alias("p")
    most = F.least(F.col("m.r"), F.col("p.p.r"))
    apart = (F.col("m.token") == F.col("p.token")) & (F.col("m.comp") != F.col("p.p.comp"))
    fits = den * most >= num * (F.col("m.n") + F.col("p.p.n") - most)
    less = F.col("m.node") < F.col("p.p.node")
    ends = {"a": ("m.node", "p.p.node"), "b": ("p.p.node", "m.node"), "na": ("m.n", "p.p.n"), "nb": ("p.p.n", "m.n")}
    return m.join(p, apart & fits).select(*[F.when(less, F.col(x)).otherwise(F.col(y)).alias(c) for c, (x, y) in ends.items()])


def neighbour_labels(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, label) of all linked nodes: the least label among a node and its neighbours, which are connected with it."""
    ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if labels is None:
        least = F.least(F.col("a"), F.min("b"))
        return ends.groupBy("a").agg(least.alias("label")).withColumnRenamed("a", "node")
    seen = ends.join(labels.withColumnRenamed("node", "b"), "b", "left")
    near = seen.groupBy("a").agg(F.min(F.coalesce("label", "b")).alias("near")).withColumnRenamed("a", "node")
    return near.join(labels, "node", "left").select("node", F.least("near", F.coalesce("label", "node")).alias("label"))


def _still_open(left: DataFrame, num: int, den: int) -> DataFrame:
    """Members that may have a partner of another label in their bucket, in buckets with two labels or more.

    A partner's set is at least ``w`` larger than the overlap, w being what its position leaves out; a member of the
    bucket's most frequent label needs a partner outside it (``apart``: it stands outside).
    """
    left = left.withColumn("w", F.col("n") - F.col("r"))
    each = left.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("w").alias("w"), F.max("r").alias("r"))
    main = each.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.min("w").alias("w_all"), F.max("r").alias("r_all"))
    main = main.select("token", F.col("m.comp").alias("main"), "w_all", "r_all")
    outside = each.join(main.select("token", "main"), "token").filter("comp <> main")
    outside = outside.groupBy("token").agg(F.min("w").alias("w_out"), F.max("r").alias("r_out"))
    marked = left.join(main.join(outside, "token"), "token").withColumn("apart", F.col("comp") != F.col("main"))
    w, r = F.when(F.col("apart"), F.col("w_all")).otherwise(F.col("w_out")), F.when(F.col("apart"), F.col("r_all")).otherwise(F.col("r_out"))
    alive = marked.filter(den * F.least(F.col("r"), r) >= num * (F.col("n") + w)).select("token", "node", "n", "r", "comp", "apart")
    mixed = alive.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return alive.join(mixed.select("token"), "token")


def linked_components(open_: DataFrame, segments: DataFrame, num: int, den: int, tmp: Scratch, first_pivots: int = 1) -> DataFrame | None:
    """(node, component) of the nodes that links connect with a smaller one; null where no bucket holds two nodes.

    open_(token, node, n, r, comp) are the buckets, as a table of tmp: r bounds what a node of n shingles can share
    with others by its bucket, comp is its label. segments(node, fragment, segment) are the sets.
    """
    links = tmp.save(open_.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), "links")
    done, labels, pivots = None, None, first_pivots
    while not open_.isEmpty():
        led = open_ if done is None else open_.filter("apart")
        best = F.struct((F.col("n") - F.col("r")).alias("w"), "node", "n", "r", "comp")
        salted = led.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(pivots)))
        lead = tmp.save(salted.groupBy("token", "salt").agg(F.min(best).alias("p")).select("token", "p"), "pivots")
        pairs = _candidates(open_, lead, num, den).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = tmp.save(pairs, "pairs")
        done = pairs.select("a", "b") if done is None else done.unionAll(pairs.select("a", "b"))
        links = links.unionAll(tmp.save(_verify(pairs, segments, num, den), "links"))
        labels = tmp.save(neighbour_labels(links, neighbour_labels(links, labels)), "labels")
        left = open_.join(lead.select("token", F.col("p.node").alias("node")), ["token", "node"], "left_anti")
        left = left.select("token", "node", "n", "r").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
        left = tmp.save(left.drop("label"), "left")
        last, open_ = open_, tmp.save(_still_open(left, num, den), "buckets")
        tmp.drop(last, left, lead)
        tmp.settle()
        pivots *= 16
    return None if done is None else tmp.save(connected_components(links, tmp), "components")


def grouped(members: DataFrame, comps: DataFrame | None, tmp: Scratch) -> DataFrame:
    """members(doc_id, row, n, key, tag) -> doc_id, n_shingles, component_id, component, tag; equal keys are one node, that of the least row."""
    classes = members.filter("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_doc"))
    named = classes if comps is None else classes.join(comps, "node", "left")
    named = tmp.save(named.withColumn("component", F.coalesce("component", "node") if comps is not None else F.col("node")), "classes")
    top = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_key = named.join(top, "component").select("key", "component_id", "component")
    out = members.join(by_key, "key", "left")
    group = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), group.alias("component_id"), "component", "tag")


def jaccard_components(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), tag: Column | None = None, first_pivots: int = 1) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, component, tag, with links where overlap / union >= threshold.

    component_id is the smallest doc_id of a component (its own for a document without words), component a number that
    its rows share (null without words), tag a binary column of docs that is handed on.
    """
    spark, (num, den) = docs.sparkSession, threshold
    tmp = Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text", (F.lit(None) if tag is None else tag).cast("binary").alias("tag"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = tmp.save(_sets(docs, k, max(1, math.ceil(chars / 6 / FRAGMENT))), "lots", "none")
    tmp.settle()
    node = _nodes(lots, num, den)
    node = node.groupBy("key").agg(F.min(F.struct("row", "n", "tokens")).alias("x")).select(
        F.col("x.row").alias("node"),
        F.col("x.n").alias("n"),
        "key",
        F.col("x.tokens").alias("tokens")
    )
    node = node.withColumn("s", F.size("tokens"))
    nodes = tmp.save(node, "nodes")
    members = tmp.save(lots.filter("kind = 0").select("doc_id", "row", "n", "key", F.col("tokens").alias("tag")), "members")
    tmp.drop(lots)
    del lots, node
    tmp.settle()

    prefix = F.slice("tokens", F.lit(1), F.col("s") - F.ceil(F.col("n") * num / den).cast("int") + 1)
    tokens = nodes.select("node", "n", "s", F.posexplode(prefix).alias("at", "token"))
    tokens = tokens.select("token", "node", "n", (F.col("s") - F.col("at")).alias("r"))  # r: shared shingles from here on
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    each = tmp.save(tokens.join(common, "token"), "shared")
    open_ = tmp.save(_merged_buckets(each).withColumn("comp", F.col("node")), "buckets")
    tmp.drop(each)
    bits = HASH_BITS - PAIR_BITS
    busy = open_.select("node").distinct()
    segments = nodes.join(busy, "node").select("node", F.explode("tokens").alias("t"))
    segments = segments.groupBy("node", F.shiftright("t", bits).cast("int").alias("fragment"))
    segments = tmp.save(segments.agg(F.collect_list("t").alias("segment")), "segments")
    tmp.drop(nodes)
    del nodes, tokens, common, each
    tmp.settle()
    comps = linked_components(open_, segments, num, den, tmp, first_pivots)

    return grouped(members, comps, tmp)
