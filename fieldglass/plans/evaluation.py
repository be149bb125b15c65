"""Predictions against targets; matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import detections, sql
from ..operators import evaluation as O
from ..operators import matching
from ..registry import query
from . import walk_sql

_D = sql("det")
r6 = lambda c: F.round(c, 6)


def _pred_gt(spark, d):
    """All rows as predictions, moved a little; even ones as targets."""
    det = detections(spark, d)
    return det.withColumn("x", F.col("x") + F.col("det_id") % 4 * 12), det.filter("det_id % 2 = 0")


def _sides(spark, d):
    """_pred_gt as one table, read and numbered once."""
    p, even = F.col("side") == 0, F.col("det_id") % 2 == 0
    det = detections(spark, d).withColumn("side", F.explode(F.when(even, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return det.withColumn("x", F.when(p, F.col("x") + F.col("det_id") % 4 * 12).otherwise(F.col("x")))


_IOU = "greatest(0.0, least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x)) * greatest(0.0, least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y))"
_C = _D + f", p AS (SELECT frame_id, class_id, det_id, confidence, x + det_id % 4 * 12 AS x, y, w, h FROM det), g AS (SELECT * FROM det WHERE det_id % 2 = 0), i AS (SELECT p.frame_id, p.class_id, p.det_id AS pred, g.det_id AS target, {_IOU} AS inter, p.w * p.h + g.w * g.h AS area FROM p JOIN g ON p.frame_id = g.frame_id AND p.class_id = g.class_id), c AS (SELECT frame_id, class_id, pred, target, inter / greatest(area - inter, 1e-6) AS iou FROM i)"


@query(_C + " SELECT frame_id, class_id, pred, target, round(iou, 6) AS iou FROM c WHERE iou >= 0.5")
def match_candidates(spark, d):
    p, g = _pred_gt(spark, d)
    return matching.candidate_matches(p, g, 0.5).select("frame_id", "class_id", "pred", "target", r6("iou").alias("iou"))


@query(
    _D + "SELECT frame_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY confidence DESC, "
    "det_id DESC) AS rank FROM det) WHERE rank <= 4"
)
def capped_predictions(spark, d):
    """The four best predictions of each image (the evaluator takes a hundred)."""
    return O.best_scored(detections(spark, d), 4).select("frame_id", "det_id")


@query(walk_sql.greedy(_C, "c.iou >= 0.5 AND c.class_id = 1") + """, t AS (SELECT count(*) AS tp FROM walk WHERE target IS NOT NULL), n AS (SELECT (SELECT count(*) FROM p WHERE class_id = 1) AS np, (SELECT count(*) FROM g WHERE class_id = 1) AS ng)
  SELECT tp, np - tp AS fp, ng - tp AS fn, round(tp / ng, 6) AS recall, round(tp / np, 6) AS precision FROM t CROSS JOIN n""")
def greedy_ball_counts(spark, d):
    """Balls found, invented and missed by greedy matches over all images."""
    p, g = _pred_gt(spark, d)
    out = O.greedy_counts(p.filter("class_id = 1"), g.filter("class_id = 1"), distance=False)
    return out.select("tp", "fp", "fn", r6("recall").alias("recall"), r6("precision").alias("precision"))


@query()
def center_assignments(spark, d):
    """Balls assigned to targets by the least sum of centre distances."""
    p, g = _pred_gt(spark, d)
    out = matching.optimal_matches(p.filter("class_id = 1"), g.filter("class_id = 1"), by="distance")
    return out.select("frame_id", "class_id", "pred", "target", r6("iou").alias("iou"), r6("distance").alias("distance"))


@query(
    _D + "SELECT frame_id, det_id, rank FROM (SELECT frame_id, det_id, row_number() OVER (PARTITION BY frame_id ORDER "
    "BY confidence DESC, det_id DESC) AS rank FROM det) WHERE rank <= 3"
)
def top_scores(spark, d):
    """The three best predictions of each image; ties go to the later one."""
    from pyspark.sql import Window as W

    w = W.partitionBy("frame_id").orderBy(F.col("confidence").desc(), F.col("det_id").desc())
    return detections(spark, d).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("frame_id", "det_id", "rank")


@query(
    walk_sql.greedy(_C, "c.iou >= 0.5") + " SELECT w.frame_id, w.class_id, w.pred, w.target, round(c.iou, 6) AS iou FROM walk w JOIN c ON c.frame_id = "
    "w.frame_id AND c.pred = w.pred AND c.target = w.target"
)
def greedy_matches(spark, d):
    p, g = _pred_gt(spark, d)
    return matching.greedy_matches(matching.candidate_matches(p, g, 0.5)).select("frame_id", "class_id", "pred", "target", r6("iou").alias("iou"))


@query()
def optimal_matches(spark, d):
    p, g = _pred_gt(spark, d)
    return matching.optimal_matches(p, g).select("frame_id", "class_id", "pred", "target", r6("iou").alias("iou"), r6("distance").alias("distance"))


_BOTH = "frame_id IN (SELECT frame_id FROM p) AND frame_id IN (SELECT frame_id FROM g)"


def _scores_sql() -> str:
    half = walk_sql.greedy(_C, "c.iou >= 0.5")
    more = walk_sql.greedy(_C, "c.iou >= 0.75")[len(_C) + len("RECURSIVE ") :]
    for name in ("s", "o", "walk"):
        more = more.replace(
            f" {name} AS (",
            f" {name}_2 AS ("
        ).replace(f"FROM {name} ", f"FROM {name}_2 ").replace(f"FROM {name})", f"FROM {name}_2)").replace(
            f"JOIN {name} ON",
            f"JOIN {name}_2 {name} ON"
        )
    return f"""{half}{more}, n AS (SELECT class_id, count(*) FILTER (WHERE side = 0) AS predictions, count(*) FILTER (WHERE side = 1) AS targets FROM (SELECT class_id, 0 AS side FROM p WHERE {_BOTH} UNION ALL SELECT class_id, 1 FROM g WHERE {_BOTH}) GROUP BY class_id),
  t AS (SELECT 0.5::DOUBLE AS iou, class_id, count(*) AS tp FROM walk WHERE target IS NOT NULL GROUP BY class_id
    UNION ALL SELECT 0.75::DOUBLE, class_id, count(*) FROM walk_2 WHERE target IS NOT NULL GROUP BY class_id),
  v AS (SELECT n.class_id, l.iou, coalesce(t.tp, 0) AS tp, n.predictions, n.targets, coalesce(t.tp, 0) / n.predictions AS p, coalesce(t.tp, 0) / n.targets AS r FROM n CROSS JOIN (VALUES (0.5::DOUBLE), (0.75::DOUBLE)) l(iou) LEFT JOIN t ON t.class_id = n.class_id AND t.iou = l.iou)
  SELECT class_id, iou, tp, predictions, targets, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(p * r, 6) AS product FROM v"""


@query(_scores_sql())
def detection_scores(spark, d):
    return O.evaluate_sides(_sides(spark, d)).select(
        "class_id",
        "iou",
        "tp",
        "predictions",
        "targets",
        *[r6(c).alias(c) for c in ("precision", "recall", "f1", "product")]
    )


@query()
def ball_scores(spark, d):
    p, g = _pred_gt(spark, d)
    return O.ball_counts(p.filter("class_id = 1"), g.filter("class_id = 1")).withColumn("mean_distance", r6("mean_distance"))


@query(
    _D + "SELECT count(DISTINCT frame_id) FILTER (WHERE class_id = 1) AS images_with_balls, round(count(*) FILTER "
    "(WHERE class_id = 1) * 1.0 / count(DISTINCT frame_id) FILTER (WHERE class_id = 1), 6) AS balls_per_image, "
    "round(count(*) * 1.0 / count(DISTINCT frame_id), 6) AS per_image FROM det"
)
def detection_rates(spark, d):
    ball = F.col("class_id") == 1
    images = F.countDistinct(F.when(ball, F.col("frame_id")))
    return detections(spark, d).agg(
        images.alias("images_with_balls"),
        r6(F.count_if(ball) / images).alias("balls_per_image"),
        r6(F.count(F.lit(1)) / F.countDistinct("frame_id")).alias("per_image")
    )


_ASSIGN = _D.replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (SELECT frame_id, det_id, x + det_id % 4 * 12 AS x, y, w, h FROM det WHERE class_id = 1), g AS (SELECT * FROM det WHERE class_id = 1 AND det_id % 2 = 0),
  q AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY det_id) AS r, count(*) OVER (PARTITION BY frame_id) AS n FROM g),
  pair AS (SELECT q.frame_id, q.r, q.n, p.det_id AS pred, sqrt(pow(p.x + p.w / 2 - q.x - q.w / 2, 2) + pow(p.y + p.h / 2 - q.y - q.h / 2, 2)) AS distance,
    greatest(0.0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0.0, least(p.y + p.h, q.y + q.h) -
      greatest(p.y, q.y)) AS inter, p.w * p.h + q.w * q.h AS area FROM q JOIN p ON p.frame_id = q.frame_id),
  cost AS (SELECT *, {cost} AS c FROM pair),
  walk AS (SELECT frame_id, r, n, [pred] AS used, c AS total FROM cost WHERE r = 1
    UNION ALL SELECT c.frame_id, c.r, c.n, list_append(w.used, c.pred), w.total + c.c FROM walk w JOIN cost c ON c.frame_id = w.frame_id
      AND c.r = w.r + 1 AND NOT list_contains(w.used, c.pred)),
  best AS (SELECT frame_id, n AS pairs, min(total) AS total FROM walk WHERE r = n GROUP BY frame_id, n)"""
_BY_DISTANCE, _BY_IOU = _ASSIGN.replace("{cost}", "distance"), _ASSIGN.replace("{cost}", "1 - inter / greatest(area - inter, 1e-6)")


@query(_BY_DISTANCE + " SELECT frame_id, pairs, round(total, 6) AS total FROM best")
def assigned_distances(spark, d):
    """The least sum of centre distances between the balls found in an image and its targets (in SQL: by trying all assignments)."""
    p, g = _pred_gt(spark, d)
    out = matching.optimal_matches(p.filter("class_id = 1"), g.filter("class_id = 1"), by="distance")
    return out.groupBy("frame_id").agg(F.count(F.lit(1)).alias("pairs"), r6(F.sum("distance")).alias("total"))


@query(_BY_IOU + " SELECT frame_id, pairs, round(total, 6) AS total FROM best")
def assigned_overlaps(spark, d):
    """The least sum of 1 - IoU between the balls found in an image and its targets."""
    p, g = _pred_gt(spark, d)
    out = matching.optimal_matches(p.filter("class_id = 1"), g.filter("class_id = 1"))
    return out.groupBy("frame_id").agg(F.count(F.lit(1)).alias("pairs"), r6(F.sum(1 - F.col("iou"))).alias("total"))


@query(_BY_DISTANCE + " SELECT round(sum(total) / sum(pairs), 6) AS mean_distance FROM best")
def pooled_ball_distance(spark, d):
    """Mean centre distance over all pairs assigned by distance."""
    p, g = _pred_gt(spark, d)
    return O.greedy_counts(p.filter("class_id = 1"), g.filter("class_id = 1")).select(r6("mean_distance").alias("mean_distance"))
