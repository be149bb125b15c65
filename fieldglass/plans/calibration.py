"""Calibration from a match's first frames, applied to all of it; a twentieth of the frame numbers is a match."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import detections, positions, sql
from ..operators import calibration as O
from ..registry import query
from .landmarks import TYPES

#: The camera of the fixture: metres from pixels.
AX, BX, AY, BY = 0.0521, -47.3, 0.0371, -19.5
_P = sql("det", "pos")
_M = f"""{_P}, m AS (SELECT frame_id % 20 AS match_id, frame_id, det_id, class_id, x + w / 2 AS x, y + h / 2 AS y FROM pos),
  f AS (SELECT match_id, frame_id, row_number() OVER (PARTITION BY match_id ORDER BY frame_id) AS r, count(*) OVER (PARTITION BY match_id) AS n
    FROM (SELECT DISTINCT match_id, frame_id FROM m)),
  o AS (SELECT m.*, r, n, CAST({AX} AS DOUBLE) * x + CAST({BX} AS DOUBLE) AS hx, CAST({AY} AS DOUBLE) * y + CAST({BY} AS DOUBLE) AS hy,
    x / CAST(1920.0 AS DOUBLE) * CAST(105.0 AS DOUBLE) - CAST(52.5 AS DOUBLE) AS fx, y / CAST(1080.0 AS DOUBLE) * CAST(68.0 AS DOUBLE) - CAST(34.0 AS DOUBLE) AS fy FROM m JOIN f USING (match_id, frame_id)),
  p AS (SELECT *, n >= 10 AND r >= 10 AS frozen, CASE WHEN n >= 10 AND r >= 10 THEN hx ELSE fx END AS px, CASE WHEN n >= 10 AND r >= 10 THEN hy ELSE fy END AS py FROM o),
  s AS (SELECT match_id, 68.0 / (max(py) - min(py)) AS k FROM p WHERE r <= 15 AND n >= 15 GROUP BY match_id HAVING count(*) >= 10 AND max(py) - min(py) >= 1),
  u AS (SELECT p.*, CASE WHEN k BETWEEN 0.5 AND 15.0 AND abs(k - 1) > 0.05 AND n >= 10 THEN k END AS k FROM p LEFT JOIN s USING (match_id))"""


def _points(spark, d):
    """match_id, frame_id, det_id, class_id and the boxes' centres as x, y."""
    pos = positions(detections(spark, d))
    return pos.select(
        (F.col("frame_id") % 20).alias("match_id"), "frame_id", "det_id", "class_id", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y")
    )


def keypoints(points):
    """Points as landmarks of types in turn, where the fixture's camera sees them on the pitch."""
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), (F.col("det_id") % 6).cast("int"))
    return points.select(
        "match_id", "frame_id", "det_id", kind.alias("type"), "x", "y", (AX * F.col("x") + BX).alias("px"), (AY * F.col("y") + BY).alias("py"), F.lit(0.9).alias("confidence")
    )


@query(
    _M + """ SELECT match_id, frame_id, det_id, round(CASE WHEN k IS NULL THEN px ELSE hx END, 6) AS px, round(CASE WHEN k IS NULL THEN py ELSE hy * k END, 6) AS py,
    CASE WHEN k IS NOT NULL THEN 'refined' WHEN frozen THEN 'frozen' ELSE 'fallback' END AS model FROM u"""
)
def calibrated_positions(spark, d):
    """Positions by the homography of a match's first ten frames, stretched by what its first fifteen frames span."""
    points = _points(spark, d)
    out = O.calibrated(points, O.frozen_homographies(keypoints(points)))
    return out.select("match_id", "frame_id", "det_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "model")


@query(_M + f""", h AS (SELECT DISTINCT match_id, max(frame_id) FILTER (WHERE r <= 10) OVER (PARTITION BY match_id) AS frozen_at FROM o WHERE n >= 10)
  SELECT match_id, frozen_at, CAST({AX} AS DOUBLE) AS sx, CAST({BX} AS DOUBLE) AS ox, CAST({AY} AS DOUBLE) AS sy, CAST({BY} AS DOUBLE) AS oy, CAST(0.0 AS DOUBLE) AS perspective FROM h""")
def frozen_homographies(spark, d):
    """The homography that each match's first ten frames give: the fixture's camera."""
    h = O.frozen_homographies(keypoints(_points(spark, d)))
    at = lambda i: F.round(F.col("homography")[i], 6) + 0.0
    flat = F.round(F.greatest(*[F.abs(F.col("homography")[i]) for i in (1, 3, 6, 7)]), 6)
    return h.select("match_id", "frozen_at", at(0).alias("sx"), at(2).alias("ox"), at(4).alias("sy"), at(5).alias("oy"), flat.alias("perspective"))


@query(_M + """, g AS (SELECT match_id, frame_id, det_id, r, n, y / 40 AS py FROM o),
  t AS (SELECT match_id, 68.0 / (max(py) - min(py)) AS k FROM g WHERE r <= 15 AND n >= 15 GROUP BY match_id HAVING count(*) >= 10 AND max(py) - min(py) >= 1)
  SELECT match_id, frame_id, det_id, round(py * CASE WHEN k BETWEEN 0.5 AND 15.0 AND abs(k - 1) > 0.05 THEN k ELSE 1.0 END, 6) AS py FROM g LEFT JOIN t USING (match_id)""")
def recalibrated_positions(spark, d):
    """Heights stretched by what a match's first fifteen frames span."""
    pos = _points(spark, d).withColumn("py", F.col("y") / 40)
    return O.recalibrated(pos).select("match_id", "frame_id", "det_id", F.round("py", 6).alias("py"))


@query(
    _M + f""" SELECT match_id, count(*) FILTER (WHERE (frame_id // 20 + det_id) % 10 >= 3) AS votes, CAST({AX} AS DOUBLE) AS sx, CAST({BX} AS DOUBLE) AS ox, CAST({AY} AS DOUBLE) AS sy, CAST({BY} AS DOUBLE) AS oy
    FROM o WHERE r <= 10 AND n >= 10 GROUP BY match_id"""
)
def consensus_homographies(spark, d):
    """The fixture's camera again, from marks three tenths of which are wild."""
    marks = keypoints(_points(spark, d))
    first = O.first_frames(marks.select("match_id", "frame_id").distinct(), ["match_id"], "frame_id", 10)
    wild = (F.floor(F.col("frame_id") / 20) + F.col("det_id")) % 10 < 3
    away = lambda c, a: F.when(wild, F.col(c) + 20 + (F.col("frame_id") * a) % 37).otherwise(F.col(c))
    marks = marks.join(first, ["match_id", "frame_id"]).withColumns({"px": away("px", 7), "py": away("py", 11)})
    h = O.consensus_homographies(marks, "match_id", ["frame_id", "det_id"])
    at = lambda i: F.round(F.col("homography")[i], 6) + 0.0
    return h.select("match_id", "votes", at(0).alias("sx"), at(2).alias("ox"), at(4).alias("sy"), at(5).alias("oy"))


@query(sql("det") + """, p AS (SELECT frame_id % 50 AS crop, CAST(x AS BIGINT) % 256 AS b, CAST(y AS BIGINT) % 256 AS g, CAST(w AS BIGINT) % 256 AS r FROM det),
  l AS (SELECT crop, b + g + r AS level, count(*) AS n, avg(b) AS b, avg(g) AS g, avg(r) AS r FROM p GROUP BY crop, b + g + r),
  c AS (SELECT *, ceil(sum(n) OVER (PARTITION BY crop) / 10.0) AS need, coalesce(sum(n) OVER (PARTITION BY crop ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
  t AS (SELECT *, greatest(0, least(n, need - before)) AS taken FROM c)
  SELECT crop, round(sum(r * taken) / max(need), 6) AS r, round(sum(g * taken) / max(need), 6) AS g, round(sum(b * taken) / max(need), 6) AS b FROM t GROUP BY crop""")
def brightest_colours(spark, d):
    """Mean colour of the brightest tenth of each crop's pixels."""
    byte = lambda c: F.col(c).cast("long") % 256
    pixels = detections(spark, d).select((F.col("frame_id") % 50).alias("crop"), byte("x").alias("b"), byte("y").alias("g"), byte("w").alias("r"))
    out = O.brightest_colour(pixels, ["crop"])
    return out.select("crop", *[F.round(c, 6).alias(c) for c in "rgb"])


def _goals(spark, d):
    """Every third box as a goal found by one of three methods, beside the place of its frame's first."""
    pos = positions(detections(spark, d))
    method = F.get(F.array(F.lit("zero_shot"), F.lit("color"), F.lit("lines")), (F.col("det_id") % 3).cast("int"))
    beside = lambda c, k: (F.col("frame_id") * k) % 1000 + F.col(c) % 97
    return pos.select(
        (F.col("frame_id") % 20).alias("match_id"), "frame_id", F.col("det_id").alias("goal_id"), method.alias("method"), beside("x", 7).alias("x"), beside("y", 3).alias("y"), "px", "confidence"
    )


@query()
def fused_goals(spark, d):
    """Goals of a frame found by several methods, fused within each side."""
    out = O.fused_goals(_goals(spark, d), ["frame_id"])
    return out.select("frame_id", "side", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n", F.round("confidence", 6).alias("confidence"))


@query()
def smoothed_goals(spark, d):
    """Goals averaged over the last ten frames with goals."""
    out = O.smoothed_goals(_goals(spark, d))
    return out.select("match_id", "frame_id", "side", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n", F.round("confidence", 6).alias("confidence"))
