"""Landmark queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import detections, positions, sql
from ..operators import landmarks as O
from ..registry import query

_P = sql("det", "pos")
TYPES = ["goal", "center_line", "corner", "penalty_box", "center_circle", "touchline"]
_TYPE = "CASE det_id % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"
_K = _P + f", k AS (SELECT frame_id, det_id, {_TYPE} AS type, x, y, px, py, confidence FROM pos)"


def keypoints(spark, d):
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), (F.col("det_id") % 6).cast("int"))
    return positions(detections(spark, d)).select("frame_id", "det_id", kind.alias("type"), "x", "y", "px", "py", "confidence")


#: How many of the pitch's landmarks have a type and priority.
_LANDMARKS = """l(type, priority, n) AS (VALUES ('center_line', 1, 1), ('center_line', 2, 2), ('center_circle', 1, 1), ('center_circle', 2, 4), ('goal', 1, 2), ('penalty_spot', 2, 2),
    ('touchline', 3, 4), ('goal_area', 3, 2), ('goal_area', 2, 4), ('corner', 1, 4), ('penalty_box', 2, 8), ('corner_arc', 3, 8))"""


@query(
    _K + f", {_LANDMARKS}, j AS (SELECT k.type, priority, n FROM k JOIN l ON l.type = k.type) SELECT type, priority, CAST(sum(n) AS BIGINT) AS pairs "
    "FROM j GROUP BY GROUPING SETS ((type), (priority), ())"
)
def landmark_counts(spark, d):
    """Pairs of detected keypoints and landmarks of their type: by type, by priority and in all."""
    seen = keypoints(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("seen"))
    pairs = seen.join(O.landmark_table(spark).select("type", "priority"), "type")
    out = pairs.groupingSets([[F.col("type")], [F.col("priority")], []], "type", "priority").agg(F.sum("seen").alias("pairs"))
    return out.select("type", "priority", "pairs")


@query(_K + """ SELECT frame_id, det_id, CASE
  WHEN NOT (x BETWEEN 0 AND 1920 AND y BETWEEN 0 AND 1080) THEN FALSE
  WHEN type = 'goal' THEN (x < 1920 * 0.35 OR x > 1920 * 0.65) AND abs(abs(px) - 52.5) <= 15
  WHEN type = 'corner' THEN (x < 1920 * 0.4 OR x > 1920 * 0.6) AND (y < 1080 * 0.4 OR y > 1080 * 0.6)
  WHEN type = 'center_circle' THEN sqrt(pow(x - 960, 2) + pow(y - 540, 2)) <= 540 AND sqrt(px * px + py * py) <= 15
  WHEN type = 'center_line' THEN abs(y - 540) <= 1080 * 0.4 AND abs(py) <= 5 ELSE TRUE END AS fits,
  x BETWEEN 0 AND 1920 AND y BETWEEN 0 AND 1080 AND abs(py) <= 5 AND abs(abs(px) - 52.5) <= 10 AND confidence >= 0.5 AND abs(y - 540) <= 1080 * 0.25
    AND CASE WHEN px < 0 THEN x <= 1920 * 0.4 ELSE x >= 1920 * 0.6 END AS goal,
  x BETWEEN 0 AND 1920 AND y BETWEEN 1080 * 0.05 AND 1080 * 0.95 AND abs(py) <= 5 AND abs(abs(px) - 52.5) <= 10 AS post FROM k""")
def averaged_checks(spark, d):
    """Keypoints by the bounds for averaged landmarks, for goals and for goal posts."""
    at = [F.col(c) for c in ("x", "y", "px", "py")]
    fits = O.plausible_average(F.col("type"), *at, 1920, 1080)
    goal, post = (O.plausible_goal(*at, F.col("confidence"), 1920, 1080, post=p) for p in (False, True))
    return keypoints(spark, d).select("frame_id", "det_id", fits.alias("fits"), goal.alias("goal"), post.alias("post"))


@query(_K + """, c AS (SELECT frame_id % 50 AS match_id, type, det_id, frame_id, x, y, px, py, confidence, floor(x / 640) * 2 + floor(y / 540) AS cluster FROM k),
  q AS (SELECT match_id, type, cluster, count(*) AS n, quantile_cont(x, 0.25) AS x1, quantile_cont(x, 0.75) AS x3, quantile_cont(y, 0.25) AS y1, quantile_cont(y, 0.75) AS y3 FROM c GROUP BY 1, 2, 3),
  i AS (SELECT c.*, q.n, x BETWEEN x1 - 1.5 * (x3 - x1) AND x3 + 1.5 * (x3 - x1) AND y BETWEEN y1 - 1.5 * (y3 - y1)
    AND y3 + 1.5 * (y3 - y1) AS inside FROM c JOIN q USING (match_id, type, cluster)),
  s AS (SELECT match_id, type, cluster, count(*) FILTER (WHERE inside) AS kept FROM i GROUP BY 1, 2, 3),
  o AS (SELECT i.* FROM i JOIN s USING (match_id, type, cluster) WHERE n < 3 OR kept < n * 0.5 OR inside)
  SELECT match_id, type, CAST(cluster AS BIGINT) AS cluster, round(median(px), 6) AS px, round(median(py), 6) AS py, count(*) AS n FROM o GROUP BY 1, 2, 3""")
def landmark_medians(spark, d):
    """Median places on the pitch of landmarks seen in several frames, without outliers in the image."""
    from ..operators import robust

    group = ["match_id", "type", "cluster"]
    cell = (F.floor(F.col("x") / 640) * 2 + F.floor(F.col("y") / 540)).cast("long")
    c = keypoints(spark, d).withColumns({"match_id": F.col("frame_id") % 50, "cluster": cell})
    out = robust.robust_average(robust.without_outliers(c, group), group, 10, ("px", "py"))
    return out.select(*group, F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "n")


@query(_K + """ SELECT frame_id, det_id, type, round(CASE WHEN CASE
  WHEN type = 'goal' THEN (x < 1920 * 0.3 OR x > 1920 * 0.7) AND abs(y - 540) <= 1080 * 0.3 AND abs(abs(px) - 52.5) <= 10
  WHEN type = 'center_line' THEN abs(y - 540) <= 1080 * 0.2 AND abs(py) <= 2
  WHEN type = 'corner' THEN (x < 1920 * 0.4 OR x > 1920 * 0.6) AND (y < 1080 * 0.4 OR y > 1080 * 0.6) AND sqrt(pow(abs(px) - 52.5, 2) + pow(abs(py) - 34, 2)) <= 15
  WHEN type = 'penalty_box' THEN abs(abs(px) - 36) < 8
  WHEN type = 'center_circle' THEN sqrt(pow(x - 960, 2) + pow(y - 540, 2)) <= 1080 * 0.4 AND sqrt(px * px + py * py) <= 10
  ELSE TRUE END THEN confidence ELSE confidence * 0.5 END, 6) AS confidence FROM k WHERE x BETWEEN 0 AND 1920 AND y BETWEEN 0 AND 1080""")
def keypoint_checks(spark, d):
    """Keypoints whose place doesn't fit their type lose half their confidence."""
    return O.validated(keypoints(spark, d), 1920, 1080).select("frame_id", "det_id", "type", F.round("confidence", 6).alias("confidence"))


_REL = "least(1.0, CASE type WHEN 'goal' THEN 0.95 WHEN 'center_line' THEN 0.90 WHEN 'penalty_box' THEN 0.75 WHEN 'center_circle' THEN 0.65 WHEN 'corner' THEN 0.50 WHEN 'touchline' THEN 0.40 ELSE 0.5 END * (1.0 - sqrt((x - 960) * (x - 960) + (y - 540) * (y - 540)) / (sqrt(1920.0 * 1920 + 1080 * 1080) / 2) * 0.3) + confidence * 0.1)"
_PRI = "CASE type WHEN 'goal' THEN 1 WHEN 'touchline' THEN 2 WHEN 'center_line' THEN 3 WHEN 'center_circle' THEN 4 WHEN 'penalty_box' THEN 5 WHEN 'corner' THEN 6 ELSE 99 END"


@query(
    _K + f" SELECT frame_id, det_id, type, rank FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY "
    f"{_PRI}, {_REL} DESC, confidence DESC, det_id) AS rank FROM k) WHERE rank <= 4"
)
def keypoint_ranking(spark, d):
    """The four best keypoints of each frame."""
    return O.calibration_points(keypoints(spark, d), ["frame_id"], 1920, 1080, 4).select("frame_id", "det_id", "type", "rank")


@query(_K + f" SELECT frame_id, det_id, round({_REL}, 6) AS reliability FROM k")
def keypoint_reliability(spark, d):
    from ..functions import labels as L

    return keypoints(spark, d).select(
        "frame_id",
        "det_id",
        F.round(L.y_reliability(F.col("type"), F.col("confidence"), F.col("x"), F.col("y"), 1920, 1080), 6).alias("reliability")
    )


@query(_K + """, t AS (SELECT *, CASE WHEN x < 960 THEN 'left' ELSE 'right' END AS side FROM k WHERE type = 'touchline' AND abs(x - 960) > 1080 * 0.2 AND y < 1080 * 0.85)
  SELECT frame_id, det_id, side FROM (SELECT *, row_number() OVER (PARTITION BY frame_id % 100, side ORDER BY -abs(x - 960), frame_id, det_id) AS rn FROM t) WHERE rn <= 4""")
def touchlines_per_side(spark, d):
    """Touchline points far from the middle and above the bottom: the four outermost of each side and group."""
    from pyspark.sql import Window as W

    k = keypoints(spark, d).filter("type = 'touchline'").filter((F.abs(F.col("x") - 960) > 1080 * 0.2) & (F.col("y") < 1080 * 0.85))
    k = k.withColumns({"side": F.when(F.col("x") < 960, "left").otherwise("right"), "g": F.col("frame_id") % 100})
    w = W.partitionBy("g", "side").orderBy(F.abs(F.col("x") - 960).desc(), "frame_id", "det_id")
    return k.withColumn("rn", F.row_number().over(w)).filter("rn <= 4").select("frame_id", "det_id", "side")
