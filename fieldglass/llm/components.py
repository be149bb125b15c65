"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large (both directions) or small star: neighbours of each node move to the least of them and it."""
    near = edges.select("a", "b")
    near = near.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else near
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = near.join(least, "a")
    if both:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def connected_components(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """edges(a, b), longs -> (node, component): the least node reachable, for nodes that are not that node themselves.

    Rounds go on until the edges no longer change. Minima are aggregated before rows are shuffled, and rows of one node are never gathered in a list.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = tmp.save(edges, "edges"), None
    while True:
        new = tmp.save(_star(_star(edges, True), False), "edges")
        now = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        tmp.drop(edges)
        edges = new
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
