"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents, in a fixed hashed order, form blocks of ``block_bytes``. A source with weight w gets block j
(from 1) the release time floor((j - 1) / w) and the deadline ceil(j / w); each time slot goes to the released block
with the earliest deadline. Weights are rounded to shares of ``quantum`` slots and sum to one, so every deadline is
met: until a source runs out, the blocks it has had by slot t differ from w * t by less than one.

Shares are whole numbers, so the schedule repeats after ``quantum`` slots. One such period is computed, and a block
finds its slot by arithmetic: however many blocks there are, nothing is simulated block by block. Slots of a source
that has run out stay empty, and later documents close up; all documents are kept.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_names, ordered_prefix, ranked

BLOCK_BYTES = 65536
#: Slots of a period at least.
QUANTUM = 1024


def target_shares(amounts: dict[str | None, float], quantum: int = QUANTUM, temperature: float = 0.7, weights: dict | None = None) -> dict:
    """Slots in a period for each source: weights (default: amount ** temperature), at least one, largest remainders first."""
    w = {s: (weights[s] if weights is not None else max(a, 1) ** temperature) for s, a in amounts.items()}
    total, spare = sum(w.values()), quantum - len(w)
    if spare < 0:
        raise ValueError("quantum must be at least the number of sources")
    exact = {s: spare * x / total for s, x in w.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s is None, s or ""))[: quantum - sum(out.values())]:
        out[s] += 1
    return out


def pfair_period(spark: SparkSession, shares: list[int]) -> DataFrame:
    """(number, turn, slot): where in the period the turn-th block of each source stands; number is its place in shares.

    A fold over the slots of one period: at slot t, of the sources whose next block is released, the earliest deadline.
    """
    q, k = sum(shares), len(shares)
    share = F.from_json(F.lit(json.dumps(shares)), "array<int>")

    def step(state, t):
        had = state["had"]
        due = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(
            F.when(
                (F.get(had, i) < F.get(share, i)) & (F.floor(F.get(had, i) * F.lit(q).cast("long") / F.get(share, i)) <= t),
                F.ceil((F.get(had, i) + 1) * F.lit(q).cast("long") / F.get(share, i)).cast("int")
            ).otherwise(F.lit(2**31 - 1)).alias("deadline"), i.alias("i")))
        i = F.array_min(due)["i"]
        nth = F.transform(
            F.array(i),
            lambda i: F.struct(
                F.transform(had, lambda x, j: F.when(j == i, x + 1).otherwise(x)).alias("had"),
                F.concat(state["out"], F.array(F.struct(i.alias("number"), F.get(had, i).alias("turn"), t.alias("slot")))).alias("out")
            )
        )
        return nth[0]

    start = F.struct(F.array_repeat(F.lit(0), k).alias("had"), F.expr("cast(array() as array<struct<number:int,turn:int,slot:int>>)").alias("out"))
    folded = F.aggregate(F.sequence(F.lit(0), F.lit(q - 1)), start, step)["out"]
    return spark.range(1).select(F.explode(folded).alias("x")).select("x.number", "x.turn", "x.slot")


def _sources(spark: SparkSession, shares: dict) -> DataFrame:
    """(name, number, share): a row for each source, from JSON, so that the plan holds one literal however many there are."""
    rows = json.dumps([{"name": s, "number": i, "share": n} for i, (s, n) in enumerate(shares.items())])
    made = F.from_json(F.lit(rows), "array<struct<name string, number int, share int>>")
    return spark.range(1).select(F.explode(made).alias("x")).select("x.name", "x.number", "x.share")


def mix_sources(docs: DataFrame, weights: dict | None = None, temperature: float = 0.7, block_bytes: int = BLOCK_BYTES, quantum: int = QUANTUM, n_buckets: int = 256) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, size, text_crc32, source_start, block, share, slot, position.

    size is the text's bytes plus 1 (null: 1), so that no document is free; block is the block in which the document
    begins; position is its place in the mixed order, gapless from 0. A period has ``quantum`` slots, or the power of
    two from twice the number of sources on, so that each source has a share.

    A null source is a source of its own; a null doc_id is ordered before others; equal doc_ids are ordered by size and
    text checksum; equal rows get neighbouring places. An empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "mixing")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row")
    )
    base = tmp.save(base, "sizes")
    amounts = {r["source"]: r["size"] for r in base.groupBy("source").agg(F.sum("size").alias("size")).collect()}  # a row for each source
    if not amounts:
        longs = [F.lit(0).cast("long").alias(c) for c in ("source_start", "block")]
        return base.select(
            "doc_id",
            "source",
            "size",
            "text_crc32",
            *longs,
            F.lit(0).alias("share"),
            *[F.lit(0).cast("long").alias(c) for c in ("slot", "position")]
        )
    quantum = max(quantum, 1 << (2 * len(amounts) - 1).bit_length())
    shares = target_shares(amounts, quantum, temperature, weights)
    shares = {s: shares[s] for s in sorted(shares, key=lambda s: (s is None, s or ""))}
    sources = tmp.save(_sources(spark, shares), "sources")
    period = tmp.save(pfair_period(spark, list(shares.values())), "period")  # quantum rows
    small = (lambda df: F.broadcast(df)) if quantum <= 65536 else (lambda df: df)
    placed = ranked(base, ["source"], ["doc_id", "text_crc32", "_row"], "source_start", n_buckets, "size")
    placed = placed.join(small(sources), F.col("source").eqNullSafe(F.col("name")))
    placed = placed.withColumn("block", F.floor(F.col("source_start") / block_bytes))
    placed = placed.withColumn("turn", (F.col("block") % F.col("share")).cast("int"))
    placed = placed.join(small(period), ["number", "turn"])
    placed = placed.withColumn("slot", F.floor(F.col("block") / F.col("share")) * quantum + F.col("slot"))
    placed = placed.select("doc_id", "source", "size", "text_crc32", "source_start", "block", "share", "slot", F.lit(1).cast("long").alias("_one"))
    out = ordered_prefix(placed, "slot", "_one", "position", tmp, ties=("source_start",))
    return out.drop("_one")


def with_positions(docs: DataFrame, out: str, **options) -> DataFrame:
    """docs, all rows and columns, with ``out``: the place in the mixed order.

    Rows that are equal in doc_id, source and text have one place, the first of them.
    """
    doc, source, size, crc, my_size, my_crc = free_names(docs, "_doc", "_source", "_size", "_crc", "_my_size", "_my_crc")
    place = mix_sources(docs, **options).groupBy(
        F.col("doc_id").alias(doc),
        F.col("source").alias(source),
        F.col("size").alias(size),
        F.col("text_crc32").alias(crc)
    ).agg(F.min("position").alias(out))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.withColumns({my_size: (F.octet_length(text) + 1).cast("long"), my_crc: F.crc32(text)})
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (
        F.col(my_size) == F.col(size)
    ) & (F.col(my_crc) == F.col(crc))
    return keyed.join(place, same).select(*docs.columns, out)


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs, all rows and columns, sorted into the mixed order."""
    (position,) = free_names(docs, "_position")
    placed = with_positions(docs, position, **options)
    return placed.repartitionByRange(position).sortWithinPartitions(position).select(*docs.columns)
