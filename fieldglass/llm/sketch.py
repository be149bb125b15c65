"""Document fingerprints by a threshold-scaled sketch, in DataFrame operations only.

A fingerprint keeps every distinct hash of a text's five-word shingles below a fixed fraction of the hash range. Its
size follows the text's, so that the share of a small text inside a large one can be told from the two fingerprints,
and the fingerprint of a union is the union of the fingerprints.

Hashes are the upper 48 bits of xxHash64. Form: ``<shingles>:<hash of the whole text>:<kept hashes>``, numbers in hex,
the kept hashes ascending, of 12 digits each. Texts with fewer words than a shingle have their whole word sequence as
one shingle; a text without words has none. Equal texts have likeness 1; otherwise likeness is the Jaccard measure of
the kept hashes (0 if neither text has any).

Null counts as the empty text. Documents with one doc_id follow each other by the texts' hashes; those without a doc_id
come last, and so border on the first. Repeated rows are documents of their own. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, let

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 2
#: Intervals of doc_id at most; their limits are broadcast.
MOST_INTERVALS = 10_000


def kept_hashes(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """struct(n: shingles in the text, h: ascending distinct hashes under the threshold)."""
    words = F.array_remove(F.split(text, SPACE_CLASS), "")

    def sketch(w: Column) -> Column:
        n = F.greatest(F.size(w) - (shingle - 1), F.least(F.size(w), F.lit(1)))
        hashed = F.transform(F.sequence(F.lit(1), n), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, F.lit(shingle))), 16))
        hashes = F.when(n > 0, hashed).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.struct(n.alias("n"), F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(2**48 // scale)))).alias("h"))

    return let(words, sketch)


def fingerprint(text: Column, sketch: Column) -> Column:
    return F.concat(
        F.lower(F.hex(sketch["n"].cast("long"))),
        F.lit(":"),
        F.lower(F.hex(F.xxhash64(text))),
        F.lit(":"),
        F.array_join(F.transform(sketch["h"], lambda h: F.lower(F.lpad(F.hex(h), 12, "0"))), "")
    )


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Jaccard measure of two arrays of kept hashes; 1 where same holds."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(same, F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; null if a keeps no hash."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def _intervals(doc_id: Column, tie: Column, limits: list[int], null_parts: int) -> Column:
    """The interval of a row, ascending by (doc_id, tie): how many of the ascending limits its doc_id is not below.

    A doc_id that k limits in a row equal is dealt to k + 1 intervals by even ranges of its ties; rows without doc_id
    stand before all others, in ``null_parts`` intervals.
    """
    share = lambda parts: F.least(F.floor((tie / F.lit(2.0**64) + 0.5) * parts), parts - 1)
    step = max(1, math.isqrt(len(limits)))
    heads = F.split(F.lit(",".join(str(x) for x in limits[::step])), ",").cast("array<bigint>")
    runs = F.split(F.lit(";".join(",".join(str(x) for x in limits[i : i + step]) for i in range(0, len(limits), step))), ";")

    def below(cond) -> Column:
        """How many limits fulfil cond, which holds for a first part of them."""
        run = F.size(F.filter(heads, cond))
        inner = F.split(F.get(runs, F.greatest(run - 1, F.lit(0))), ",").cast("array<bigint>")
        return F.when(run == 0, F.lit(0)).otherwise((run - 1) * step + F.size(F.filter(inner, cond)))

    nowhere = share(F.lit(null_parts)) - null_parts
    if not limits:
        return F.when(doc_id.isNull(), nowhere).otherwise(F.lit(0))
    less, upto = below(lambda x: x < doc_id), below(lambda x: x <= doc_id)
    return F.when(doc_id.isNull(), nowhere).otherwise(less + F.when(upto > less, share(upto - less + 1)).otherwise(F.lit(0)))


def fingerprint_documents(docs: DataFrame, rows_each: int = 200) -> DataFrame:
    """The fingerprint of each text, of its edited text, and their likenesses; see the contract of op8.

    A document's neighbour is the next one by descending doc_id. Rows are dealt to intervals of doc_id between
    percentiles, of about ``rows_each`` rows (more, if that takes over MOST_INTERVALS); the first row of each interval
    also goes to the interval that needs it, so that each text is shuffled once, before it is hashed.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, nulls = base.agg(F.count(F.lit(1)), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    cuts = min(MOST_INTERVALS, (n - nulls) // rows_each)
    limits = []
    if cuts > 0:
        at = F.percentile_approx("doc_id", [k / (cuts + 1) for k in range(1, cuts + 1)], max(10_000, 5 * cuts))
        limits = sorted(base.agg(at).first()[0])
    null_parts = max(1, min(MOST_INTERVALS, nulls // rows_each))
    own = base.withColumn("_t", F.xxhash64("text"))
    own = own.withColumn("_b", -_intervals(F.col("doc_id"), F.col("_t"), limits, null_parts).cast("long"))
    # The intervals that have rows, in order, each with the one before it (the first: the last), whose last row needs its first.
    tmp = Scratch(spark, "sketch")
    key = F.struct(F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1)).alias("k"), F.bitwise_not("_t").alias("t"))
    firsts = own.groupBy("_b").agg(F.min(key).alias("f"))
    firsts = tmp.save(firsts.select("_b", F.col("f.k").alias("_k"), F.col("f.t").alias("_m")), "firsts")
    numbered = _linked(firsts)
    keyed = own.withColumn("_k", key["k"]).withColumn("_m", key["t"])
    heads = keyed.join(F.broadcast(numbered), ["_b", "_k", "_m"]).dropDuplicates(["_b"])
    heads = heads.select(F.col("_to").alias("_b"), "doc_id", "text", "_t", F.lit(1).alias("_head"))
    rows = own.select("_b", "doc_id", "text", "_t", F.lit(0).alias("_head")).unionByName(heads)
    rows = rows.repartition("_b").withColumn("_s", kept_hashes(F.col("text")))  # texts are shuffled, not their hashes
    order = W.partitionBy("_b").orderBy("_head", F.col("doc_id").desc(), F.col("_t").desc())
    near = rows.withColumn("_n", F.lead(F.struct("text", "_s")).over(order)).filter("_head = 0")
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("_n.text"), F.lit(1), third))
    out = near.select(
        "doc_id",
        "text",
        "_s",
        F.col("_n._s.h").alias("_next"),
        (F.col("_n.text") == F.col("text")).alias("_same"),
        edited.alias("_edited")
    )
    out = out.withColumn("_e", kept_hashes(F.col("_edited")))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), F.col("_s")).alias("fingerprint"),
        fingerprint(F.col("_edited"), F.col("_e")).alias("edited_fingerprint"),
        likeness(F.col("_s.h"), F.col("_e.h"), F.col("_edited") == F.col("text")).alias("near_edited"),
        likeness(F.col("_s.h"), F.col("_next"), F.col("_same")).alias("near_next"),
        containment(F.col("_s.h"), F.col("_e.h")).alias("contained_edited"),
    )


def _linked(firsts: DataFrame) -> DataFrame:
    """firsts(_b, ...) with _to: the interval before it in order (the first: the last). firsts has 2 * MOST_INTERVALS rows at most."""
    before, last = F.lag("_b").over(W.orderBy("_b")), F.max("_b").over(W.partitionBy(F.lit(0)))
    return firsts.select("*", F.coalesce(before, last).alias("_to"))
