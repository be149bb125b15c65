"""Comparisons of stored and fresh results, extents, summaries and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import detections, positions, sql, table
from ..operators import cluster, matching
from ..operators import datasets as D
from ..registry import query
from . import walk_sql

_D, _P = sql("det"), sql("det", "pos")
r6 = lambda c: F.round(c, 6)


@query(_D + """, c AS (SELECT p.frame_id, p.det_id, q.det_id AS match, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) / 20 AS distance FROM det p JOIN det q ON p.frame_id = q.frame_id AND q.det_id % 2 = 0 WHERE p.det_id % 2 = 1),
  b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY frame_id, det_id ORDER BY distance, match) = 1)
  SELECT frame_id, det_id, match, round(distance, 6) AS distance, distance > 10 AS mismatch, distance > 20 AS far FROM b""")
def stored_mismatches(spark, d):
    """Stored boxes against the nearest fresh one: off by over 10, and by over 20 pixels."""
    det = detections(spark, d)
    near = matching.nearest(det.filter("det_id % 2 = 1"), det.filter("det_id % 2 = 0"), ["frame_id"], "det_id", "det_id")
    # divided after the root: equal distances stay equal
    return matching.flagged(near.withColumn("distance", F.col("distance") / 20)).withColumn("distance", r6("distance"))


@query(_D + """, a AS (SELECT frame_id, x, confidence FROM det WHERE frame_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY det_id DESC) = 1),
  b AS (SELECT frame_id, x, confidence FROM det WHERE frame_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY det_id DESC) = 1)
  SELECT a.frame_id, a.x AS x_a, b.x AS x_b, a.confidence AS confidence_a, b.confidence AS confidence_b FROM a JOIN b ON a.frame_id = b.frame_id""")
def last_entries_compared(spark, d):
    """Two runs on the frames that both have, the last entry of a frame replacing earlier ones."""
    det = detections(spark, d).select("frame_id", "det_id", "x", "confidence")
    run = lambda k, s: D.last_of_each(det.filter(F.col("frame_id") % k == 0), ["frame_id"], ["det_id"]).select(
        "frame_id", F.col("x").alias(f"x_{s}"), F.col("confidence").alias(f"confidence_{s}")
    )
    return run(2, "a").join(run(3, "b"), "frame_id")


@query(
    _P + ", p AS (SELECT frame_id % 10 AS run, CASE WHEN det_id % 3 > 0 THEN px END AS x_pitch, [px, py] AS pitch_position, py FROM pos WHERE class_id = 0) SELECT run, "
    "round(min(coalesce(x_pitch, pitch_position[1])), 6) AS x_min, round(max(coalesce(x_pitch, pitch_position[1])), 6) AS x_max, round(min(py), 6) AS y_min, round(max(py), 6) AS y_max FROM p GROUP BY run"
)
def pitch_extents(spark, d):
    """How far all players reach, whichever of two fields holds their place."""
    pos = positions(detections(spark, d)).filter("class_id = 0")
    rows = pos.select((F.col("frame_id") % 10).alias("run"), F.when(F.col("det_id") % 3 > 0, F.col("px")).alias("x_pitch"), F.array("px", "py").alias("pitch_position"))
    out = D.pitch_extent(rows.withColumn("y_pitch", F.lit(None).cast("double")), ["run"])
    return out.select("run", *[r6(c).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


@query(walk_sql._kept(["frame_id"], "w * h DESC, det_id", "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 30", "frame_id, det_id"))
def regions(spark, d):
    """Regions of a frame from the largest down, each 30 pixels or more from those kept before."""
    sized = detections(spark, d).withColumn("area", F.col("w") * F.col("h"))
    return cluster.spaced(sized, ["frame_id"], ["area", "det_id"], 30.0, [False, True]).select("frame_id", "det_id")


@query("""WITH a AS (SELECT o_orderkey % 3 AS source, o_custkey % 4 AS category_id FROM orders), i AS (SELECT c_nationkey % 3 AS source, count(*) AS images FROM customer GROUP BY 1),
  n AS (SELECT source, count(*) AS annotations FROM a GROUP BY 1), k AS (SELECT s.source, c.id, count(a.source) AS n
    FROM (SELECT unnest([0, 1, 2]) AS source) s CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS id) c LEFT JOIN a ON a.source = s.source
    AND a.category_id = c.id GROUP BY 1, 2),
  t AS (SELECT source, count(*) AS categories, string_agg(id || ':' || n, ',' ORDER BY id) AS by_category FROM k GROUP BY 1)
  SELECT i.source, images, annotations, categories, by_category, printf('%.1f', annotations / images) AS annotations_each FROM i JOIN n ON n.source = i.source JOIN t ON t.source = i.source""")
def dataset_summaries(spark, d):
    """Images, annotations and their categories of three datasets; means with one decimal."""
    marks = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("source"), (F.col("o_custkey") % 4).alias("category_id"))
    images = table(spark, d, "customer").select((F.col("c_nationkey") % 3).alias("source"))
    sources = images.distinct()
    kinds = sources.select("source", F.explode(F.array(*[F.lit(i).cast("long") for i in range(5)])).alias("id")).withColumn("name", F.concat(F.lit("kind"), "id"))
    out = D.dataset_summary(images, marks, kinds)
    listed = F.array_join(F.transform("by_category", lambda c: F.concat_ws(":", c["category_id"], c["n"])), ",")
    return out.select("source", "images", "annotations", "categories", listed.alias("by_category"), F.format_string("%.1f", "annotations_each").alias("annotations_each"))
