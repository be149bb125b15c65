"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that share a link pull each other into one shard. A link is any group of documents: an edge of a graph (two
documents), or equal texts (as many as there are); a document may have several. In each round documents ask to join the
shard that holds most of their neighbours; requests are granted under capacity quotas: swaps between two shards first,
then free places. Documents without a link fill what is left, so that the counts of any two shards differ by one at
most.

Documents with the same links are exchangeable, so a round works on blocks (class, shard, members): a class has one row
for each shard at most, however many documents it has. A class moves up the shards in one of two rounds and down in
the other, in an order by a hash, so that neighbours don't pass each other. Only the requests between shards, n_shards
squared numbers at most, come to the driver, which sets the quotas.

The cut of a link is M - sum(m * m) / M, for M members of which m stand in each shard: 1 for a cut edge, and the pairs
apart over M / 2 for more members. Rounds go on until ``patience`` of them in a row have not lowered the sum of cuts by
the ``least`` part of it (less than one edge up to a million); the state with the smallest sum is taken.

Null texts count as empty ones; an empty table gives an empty result; a doc_id that comes twice, or is null, is a row as
any other. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, ranked


def _quotas(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may go from s to t: swaps of equal numbers, then into free places, large requests first."""
    granted = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
    room = list(room)
    for (s, t), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - granted[s, t], room[t])
        granted[s, t] += more
        room[t] -= more
    return granted


def edge_links(edges: DataFrame) -> DataFrame:
    """edges(a, b) between nodes -> members(node, link), with a link for each edge."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    named = F.concat(lo.cast("string"), F.lit(" "), hi.cast("string")).cast("binary")
    return edges.filter("a <> b").select(F.explode(F.array(lo, hi)).alias("node"), named.alias("link"))


def cut_links(placed: DataFrame, members: DataFrame) -> DataFrame:
    """link, members, shards, cut: over how many shards a link's members stand, and its cut: 1 for an edge that is cut."""
    parts = members.distinct().join(placed.select("node", "shard"), "node").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("m"))
    return parts.groupBy("link").agg(F.sum("m").alias("members"), F.count(F.lit(1)).alias("shards"), _cut(F.col("m")).alias("cut"))


def _cut(m: Column) -> Column:
    """The cut of a link as an aggregate of its parts."""
    return F.sum(m) - F.sum(m.cast("double") * m) / F.sum(m)


def _classes(members: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame, bool]:
    """(node, class) of linked nodes, (class, link, members, deg), and whether each class has a link to itself.

    A class is a digest of its links by exclusive or, so that no node's links are gathered in a list.
    """
    members = members.distinct()
    shared = members.groupBy("link").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("link")
    linked = tmp.save(members.join(shared, "link"), "linked")
    digest = F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(F.xxhash64("link")), F.bit_xor(F.xxhash64("link", F.lit(1))))
    of = tmp.save(linked.groupBy("node").agg(F.unhex(F.md5(digest.cast("binary"))).alias("class")), "classes")
    links = linked.join(of, "node").groupBy("class", "link").agg(F.count(F.lit(1)).alias("members"))
    deg = links.groupBy("class").agg(F.count(F.lit(1)).alias("deg"))
    links = tmp.save(links.join(deg, "class"), "class-links")
    most, classes, n = links.agg(F.max("deg"), F.countDistinct("class"), F.countDistinct("link")).first()
    return of, links, (most or 1) == 1 and classes == n


def balanced_label_propagation(nodes: DataFrame, members: DataFrame, n_shards: int = 16, patience: int = 4, least: float = 1e-6, n_buckets: int = 256) -> DataFrame:
    """nodes(node, ...) with ``shard`` and ``slot``; node is a unique long, members(node, link) has a row for each link of a node.

    law ``rows``: shard sizes differ by one document at most. nodes is read several times: pass a saved table.
    """
    tmp = Scratch(nodes.sparkSession, "sharding")
    n = nodes.count()
    quota = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    first = ranked(nodes.select("node"), [], ["node"], "_rank", n_buckets).withColumn("shard", (F.col("_rank") % n_shards).cast("int"))
    first = tmp.save(first.select("node", "shard"), "first")
    of, links, simple = _classes(members, tmp)
    sizes = links.groupBy("class").agg(F.max("members").alias("members"), F.max("deg").alias("deg"))
    blocks = first.join(of, "node").groupBy("class", "shard").agg(F.count(F.lit(1)).alias("n"))
    blocks = tmp.save(blocks.join(sizes, "class"), "blocks")

    def held(blocks: DataFrame) -> list[int]:
        out = [0] * n_shards
        for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            out[r["shard"]] = r["n"]
        return out

    best, best_cut, stale, step = blocks, None, 0, 0
    while True:
        if simple:  # a class is a link
            parts = blocks.select("class", "shard", F.col("n").alias("m"))
            cut = parts.groupBy("class").agg(_cut(F.col("m")).alias("cut"))
        else:
            parts = links.join(blocks, "class").groupBy("link", "shard").agg(F.sum("n").alias("m"))
            parts = tmp.save(parts, "parts")
            cut = parts.groupBy("link").agg(_cut(F.col("m")).alias("cut"))
        cut = cut.agg(F.sum("cut")).first()[0] or 0.0
        stale = 0 if best_cut is None or cut < best_cut - least * best_cut else stale + 1
        if best_cut is None or cut < best_cut:
            best, best_cut = blocks, cut
        if best_cut < 0.5 or stale >= patience:
            break
        step += 1
        mine = held(blocks)
        room = [q - h for q, h in zip(quota, mine, strict=True)]
        scores = parts if simple else links.select("class", "link").join(parts, "link").groupBy("class", "shard").agg(F.sum("m").alias("m"))
        asks = tmp.save(_requests(blocks, scores, room, step, simple), "asks")
        asked = {(r["shard"], r["to"]): r["n"] for r in asks.filter("`to` IS NOT NULL").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        granted = _quotas(asked, room)
        most = F.array(*[F.lit(granted.get((s, t), 0)).cast("long") for s in range(n_shards) for t in range(n_shards)])
        some = ranked(asks.filter("`to` IS NOT NULL"), ["shard", "to"], ["class"], "_before", 32, "n")
        go = F.greatest(F.lit(0), F.least(F.col("n"), F.get(most, F.col("shard") * n_shards + F.col("to")) - F.col("_before")))
        some = some.withColumn("_go", go)
        moved = asks.filter("`to` IS NULL").select("class", "shard", "n", "deg", "members")
        moved = moved.unionAll(some.select("class", F.col("to").alias("shard"), F.col("_go").alias("n"), "deg", "members"))
        moved = moved.unionAll(some.select("class", "shard", (F.col("n") - F.col("_go")).alias("n"), "deg", "members"))
        moved = moved.filter("n > 0").groupBy("class", "shard")
        blocks = tmp.save(moved.agg(F.sum("n").alias("n"), F.max("deg").alias("deg"), F.max("members").alias("members")), "blocks")
        tmp.drop(asks, *([] if simple else [parts]))

    # Members of a class take its blocks' places by their rank; a large class is ranked in pieces of about 1024.
    linked = of.join(sizes.select("class", "members"), "class")
    linked = linked.withColumn("_piece", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / 1024)).cast("int"))
    pieces = linked.groupBy("class", "_piece").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy("class").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    cells = best.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "shard")), asc=False).alias("cells"))
    pieces = pieces.join(cells, "class").select("class", "_piece", "_offset", "cells")
    within = W.partitionBy("class", "_piece").orderBy("node")
    placed = linked.withColumn("_at", F.row_number().over(within) - 1).join(pieces, ["class", "_piece"])
    at = F.col("_at") + F.col("_offset")
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(-1).alias("shard"))
    pick = F.aggregate(
        "cells",
        none,
        lambda a, c: F.when(a["end"] > at, a).otherwise(F.struct((a["end"] + c["n"]).alias("end"), c["shard"].alias("shard")))
    )
    placed = placed.select("node", pick["shard"].alias("shard"))

    alone = tmp.save(nodes.select("node").join(of.select("node"), "node", "left_anti"), "alone")
    ends, total = [], 0
    for q, h in zip(quota, held(best), strict=True):
        total += q - h
        ends.append(total)
    shard = F.lit(n_shards - 1)
    for s in reversed(range(n_shards - 1)):
        shard = F.when(F.col("_rank") < ends[s], F.lit(s)).otherwise(shard)
    alone = ranked(alone, [], ["node"], "_rank", n_buckets).select("node", shard.cast("int").alias("shard"))

    shards = tmp.save(placed.unionAll(alone), "shards")
    shards = ranked(shards, ["shard"], ["node"], "slot", n_buckets)
    return nodes.join(shards, "node")


def _requests(blocks: DataFrame, scores: DataFrame, room: list[int], step: int, simple: bool) -> DataFrame:
    """blocks with ``to``: the shard that a block asks to join, or null.

    scores(class, shard, m) tells how many places of the class's links a shard holds. A block asks for the shard with
    most of them, if that is more than stays behind, and not less than its members have in each other, in this step's
    direction: one with room, else a full one (which a swap may open). Where all parts of a link stand in full shards,
    they ask to meet in one that has room for the whole link.
    """
    full = not any(room)
    free = F.array(*[F.lit(x).cast("long") for x in room])
    cells = F.sort_array(F.collect_list(F.struct("m", F.xxhash64("class", "shard").alias("tie"), "shard")), asc=False)
    each = blocks.join(scores.groupBy("class").agg(cells.alias("cells")), "class")
    mine = F.get(F.filter("cells", lambda c: c["shard"] == F.col("shard")), F.lit(0))["m"]
    stays = mine - F.col("n") * F.col("deg")
    inside = (F.col("n") - 1) * F.col("deg")
    up = F.pmod(F.pmod(F.xxhash64("class", F.lit(step // 2)), F.lit(2)) + step % 2, F.lit(2)) == 1

    def fits(c):
        ahead = F.when(up, c["shard"] > F.col("shard")).otherwise(c["shard"] < F.col("shard"))
        return ahead & (c["m"] > stays) & (c["m"] >= inside)

    first = lambda cells: F.get(cells, F.lit(0))["shard"]
    to = first(F.filter("cells", fits))
    if not full:
        opened = lambda c: F.get(free, c["shard"]) > 0
        to = F.coalesce(first(F.filter("cells", lambda c: fits(c) & opened(c))), to)
        if simple:
            spots = F.transform(F.sequence(F.lit(0), F.lit(len(room) - 1)), lambda t: F.struct(F.xxhash64("class", t).alias("tie"), t.alias("shard")))
            meet = F.array_max(F.filter(spots, lambda x: F.get(free, x["shard"]) >= F.col("members")))["shard"]
            shut = (F.size("cells") > 1) & ~F.exists("cells", opened) & F.lit(step % 2 == 0)
            to = F.when(shut, F.coalesce(meet, to)).otherwise(to)
    return each.select("class", "shard", "n", "deg", "members", to.alias("to"))


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``). Links: equal texts."""
    tmp = Scratch(docs.sparkSession, "shard-documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    nodes = docs.select(
        F.monotonically_increasing_id().alias("node"),
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("link")
    )
    nodes = tmp.save(nodes, "nodes")
    out = balanced_label_propagation(nodes, nodes.select("node", "link"), n_shards)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard")
    )
