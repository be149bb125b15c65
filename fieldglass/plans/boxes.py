"""Geometry of boxes, filters, overlaps and nearest neighbours within frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import detections, positions, sql
from ..functions import geometry as G
from ..functions import labels as L
from ..operators import cluster, matching
from ..registry import query
from . import walk_sql

_D, _P = sql("det"), sql("det", "pos")
r6 = lambda c: F.round(c, 6)
#: A homography for the examples: the image's four corners on the pitch's, with a slight tilt.
H = [0.0901373, 0.0020719, -58.01371, 0.0010393, 0.0701171, -37.51393, 0.00010133, 0.00020717, 1.0003]
_IOU = "greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(
    _D + """SELECT frame_id, det_id, x + w / 2 AS cx, y + h / 2 AS cy, x + w / 2 AS feet_x, y + h AS feet_y, x + w AS x2, y + h AS y2, w * h AS area, round(x / 1920 * 100, 6) AS x_percent, round((x + w / 2) / 1920, 7) AS ncx, round(h / 1080, 7) AS nh FROM det"""
)
def box_forms(spark, d):
    det = detections(spark, d)
    x1, y1, x2, y2 = G.to_corners("x", "y", "w", "h")
    cx, cy = G.center("x", "y", "w", "h")
    fx, fy = G.feet(x1, x2, y2)
    return det.select(
        "frame_id",
        "det_id",
        cx.alias("cx"),
        cy.alias("cy"),
        fx.alias("feet_x"),
        fy.alias("feet_y"),
        x2.alias("x2"),
        y2.alias("y2"),
        G.area("w", "h").alias("area"),
        r6(G.percent_of("x", 1920)).alias("x_percent"),
        F.round(cx / 1920, 7).alias("ncx"),
        F.round(F.col("h") / 1080, 7).alias("nh")
    )


@query(
    _D + """SELECT frame_id, det_id, greatest(0.0, least(x, 1920)) AS x1, greatest(0.0, least(y, 1080)) AS y1, least(x + w, 1920) AS x2, least(y + h, 1080) AS y2 FROM det WHERE least(x + w, 1920) > x AND least(y + h, 1080) > y"""
)
def box_clip(spark, d):
    """Boxes cut at the image's edge, empty ones dropped."""
    x1, y1, x2, y2 = G.clip_box("x", "y", "w", "h", 1920, 1080)
    return detections(spark, d).select(
        "frame_id",
        "det_id",
        x1.alias("x1"),
        y1.alias("y1"),
        x2.alias("x2"),
        y2.alias("y2")
    ).filter("x2 > x1 AND y2 > y1")


@query(
    _P + "SELECT frame_id, det_id, round(px, 6) AS px, round(py, 6) AS py, round(sqrt(px * px + py * py), 6) AS "
    "to_center, round((px + 52.5) / 105.0 * 1050, 6) AS map_x, round((py + 34.0) / 68.0 * 680, 6) AS map_y FROM pos"
)
def pitch_positions(spark, d):
    pos = positions(detections(spark, d))
    mx, my = G.pitch_to_map("px", "py", 1050, 680)
    return pos.select(
        "frame_id",
        "det_id",
        r6("px").alias("px"),
        r6("py").alias("py"),
        r6(G.distance_to_center("px", "py")).alias("to_center"),
        r6(mx).alias("map_x"),
        r6(my).alias("map_y")
    )


def _h(x: str, y: str) -> tuple[str, str]:
    w = f"({H[6]} * ({x}) + {H[7]} * ({y}) + CAST({H[8]} AS DOUBLE))"
    w = f"(CASE WHEN abs{w} < 1e-10 THEN 1e-10 ELSE {w} END)"
    return f"(({H[0]} * ({x}) + {H[1]} * ({y}) + {H[2]}) / {w})", f"(({H[3]} * ({x}) + {H[4]} * ({y}) + {H[5]}) / {w})"


_hc, _corners = _h("x + w / 2", "y + h / 2"), [_h(a, b) for a in ("x", "x + w") for b in ("y", "y + h")]


@query(
    _D + f"""SELECT frame_id, det_id, round({_hc[0]}, 5) AS hx, round({_hc[1]}, 5) AS hy, round(least({", ".join(c[0] for c in _corners)}), 5) AS bx1, round(greatest({", ".join(c[1] for c in _corners)}), 5) AS by2 FROM det"""
)
def homography_map(spark, d):
    """Centres and bounding boxes through a homography."""
    hx, hy = G.homography(H, *G.center("x", "y", "w", "h"))
    b = G.transform_box(H, *G.to_corners("x", "y", "w", "h"))
    return detections(spark, d).select(
        "frame_id",
        "det_id",
        F.round(hx, 5).alias("hx"),
        F.round(hy, 5).alias("hy"),
        F.round(b[0], 5).alias("bx1"),
        F.round(b[3], 5).alias("by2")
    )


@query(
    _D + "SELECT frame_id, det_id, class_id, confidence FROM det WHERE confidence >= 0.7 AND class_id = 0 AND w > 0 AND "
    "h > 0 AND NOT (x = 0 AND y = 0 AND w = 0 AND h = 0)"
)
def filter_confident(spark, d):
    det = detections(spark, d)
    return det.filter(
        "confidence >= 0.7 AND class_id = 0 AND w > 0 AND h > 0"
    ).filter("NOT (x = 0 AND y = 0 AND w = 0 AND h = 0)").select("frame_id", "det_id", "class_id", "confidence")


@query(_D + "SELECT DISTINCT frame_id FROM det WHERE class_id = 1")
def frames_with_ball(spark, d):
    """Frames that have a ball, by existence."""
    det = detections(spark, d)
    return det.select("frame_id").distinct().join(det.filter("class_id = 1").select("frame_id"), "frame_id", "left_semi")


@query(_P + "SELECT frame_id, det_id, px BETWEEN -100 AND 100 AND py BETWEEN -250 AND 50 AS valid, abs(px) > 52.5 - 16.5 AS in_box FROM pos")
def position_validity(spark, d):
    pos = positions(detections(spark, d))
    return pos.select(
        "frame_id",
        "det_id",
        (F.col("px").between(-100, 100) & F.col("py").between(-250, 50)).alias("valid"),
        G.in_penalty_box("px").alias("in_box")
    )


@query(
    _D + """SELECT frame_id, det_id FROM det WHERE class_id = 0 AND w * h BETWEEN 2000 AND 50000 AND y >= 1080 * CASE WHEN h / w > 3 THEN 0.10 ELSE 0.15 END AND (h / w > 3 OR y + h <= 1080 * 0.9)"""
)
def plausible_players(spark, d):
    """Player boxes of plausible size and place; tall ones may stand higher and lower."""
    tall = F.col("h") / F.col("w") > 3
    ok = F.col("w") * F.col("h")
    det = detections(spark, d).filter(
        (F.col("class_id") == 0) & ok.between(2000, 50000) & (
            F.col("y") >= 1080 * F.when(tall, 0.10).otherwise(0.15)
        ) & (tall | (F.col("y") + F.col("h") <= 1080 * 0.9))
    )
    return det.select("frame_id", "det_id")


@query(_D + f""", o AS (SELECT a.frame_id, a.det_id AS a, b.det_id AS b, {_IOU} AS inter, a.w * a.h + b.w * b.h AS area FROM det a JOIN det b ON a.frame_id = b.frame_id AND a.det_id < b.det_id AND a.class_id = b.class_id)
  SELECT frame_id, a, b, round(inter / greatest(area - inter, 1e-6), 6) AS iou FROM o WHERE inter / greatest(area - inter, 1e-6) > 0.5""")
def overlap_pairs(spark, d):
    return matching.overlapping_pairs(detections(spark, d)).withColumn("iou", r6("iou"))


_PAIR = "c AS (SELECT p.frame_id, p.det_id, q.det_id AS match, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS distance FROM det p JOIN det q ON p.frame_id = q.frame_id AND q.det_id % 2 = 0 WHERE p.det_id % 2 = 1)"


@query(
    _D + f", {_PAIR} SELECT frame_id, det_id, match, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY frame_id, det_id ORDER BY distance, match) AS rn FROM c) WHERE rn = 1"
)
def nearest_stored(spark, d):
    """Each odd detection's nearest even one in its frame."""
    det = detections(spark, d)
    out = matching.nearest(det.filter("det_id % 2 = 1"), det.filter("det_id % 2 = 0"), ["frame_id"], "det_id", "det_id")
    return out.withColumn("distance", r6("distance"))


@query(
    _D + f", {_PAIR} SELECT frame_id, det_id, match, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY frame_id, det_id ORDER BY distance, match) AS rn FROM c WHERE distance < 300) WHERE rn = 1"
)
def nearest_within(spark, d):
    """The same within a radius; several may take one."""
    det = detections(spark, d)
    out = matching.nearest(det.filter("det_id % 2 = 1"), det.filter("det_id % 2 = 0"), ["frame_id"], "det_id", "det_id", 300.0)
    return out.withColumn("distance", r6("distance"))


@query(
    _D + f"""SELECT a.frame_id, a.det_id FROM det a WHERE a.det_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM det b WHERE b.frame_id = a.frame_id AND b.det_id % 2 = 0 AND {_IOU} / (a.w * a.h + b.w * b.h - {_IOU}) > 0.1)"""
)
def paste_candidates(spark, d):
    """Odd detections that overlap no even one."""
    det = detections(spark, d)
    return matching.without_overlap(det.filter("det_id % 2 = 1"), det.filter("det_id % 2 = 0")).select("frame_id", "det_id")


@query(_D + """, l AS (SELECT frame_id, det_id, h / sqrt(h * h + w * w) AS a, -w / sqrt(h * h + w * w) AS b, ((x + w) * y - x * (y + h)) / sqrt(h * h + w * w) AS c FROM det),
  p AS (SELECT l.frame_id, l.det_id AS i, r.det_id AS j, l.a * r.b - r.a * l.b AS det, l.b * r.c - r.b * l.c AS nx, r.a * l.c - l.a * r.c AS ny FROM l JOIN l r ON l.frame_id = r.frame_id AND l.det_id < r.det_id)
  SELECT frame_id, i, j, CAST(floor((nx / det + 0.37) / 10) AS BIGINT) AS cell_x, CAST(floor((ny / det + 0.37) / 10) AS BIGINT) AS cell_y FROM p WHERE abs(det) >= 0.01""")
def line_crossings(spark, d):
    """Crossings of the boxes' diagonals in a frame, by cells of ten pixels; nearly parallel ones are left out."""
    a, b, c = G.segment_line(*G.to_corners("x", "y", "w", "h"))
    lines = detections(spark, d).select("frame_id", F.col("det_id").alias("line_id"), a.alias("a"), b.alias("b"), c.alias("c"))
    l, r = lines.alias("l"), lines.alias("r")
    det = F.col("l.a") * F.col("r.b") - F.col("r.a") * F.col("l.b")
    x, y = G.line_intersection(tuple(F.col(f"l.{k}") for k in "abc"), tuple(F.col(f"r.{k}") for k in "abc"), 0.01)
    both = l.join(r, (F.col("l.frame_id") == F.col("r.frame_id")) & (F.col("l.line_id") < F.col("r.line_id")) & (F.abs(det) >= 0.01))
    return both.select(
        "l.frame_id",
        F.col("l.line_id").alias("i"),
        F.col("r.line_id").alias("j"),
        F.floor((x + 0.37) / 10).alias("cell_x"),
        F.floor((y + 0.37) / 10).alias("cell_y")
    )


@query(
    _D + "SELECT class_id, round_even(x / 8, 0) * 8 AS cell_x, round_even(y / 8, 0) * 8 AS cell_y, median(x) AS x, "
    "median(y) AS y, count(*) AS n FROM det GROUP BY ALL"
)
def grid_fuse(spark, d):
    """Detections fused on an 8-pixel grid."""
    return cluster.grid_fuse(detections(spark, d), ["class_id"])


@query(walk_sql.NMS)
def nms(spark, d):
    """Non-maximum suppression within frame and class."""
    det = detections(spark, d)
    return cluster.suppress_overlaps(det, ["frame_id", "class_id"]).select("frame_id", "class_id", "det_id", "confidence")


@query(walk_sql.LEADER)
def leader_clusters(spark, d):
    """Leader clusters of detections within 50 pixels of their seed."""
    return cluster.leader_clusters(
        detections(spark, d),
        ["frame_id", "class_id"],
        ["det_id"],
        50.0
    ).select("frame_id", "class_id", "det_id", "cluster")


@query()
def mean_clusters(spark, d):
    """Clusters within 100 pixels of their running mean."""
    return cluster.leader_clusters(
        detections(spark, d).select("frame_id", "det_id", "confidence", "x", "y"),
        ["frame_id"],
        ["confidence", "det_id"],
        100.0,
        "mean",
        [False, True]
    ).select("frame_id", "det_id", "cluster")


@query(walk_sql.LINKED)
def linked_clusters(spark, d):
    """Clusters of detections linked within 120 pixels."""
    return cluster.linked_clusters(detections(spark, d).select("frame_id", "det_id", "x", "y"), ["frame_id"], 120.0).select("frame_id", "det_id", "cluster")


@query(walk_sql.SPACED)
def spaced_points(spark, d):
    """Detections kept in order of confidence, at least 60 pixels apart."""
    return cluster.spaced(detections(spark, d), ["frame_id"], ["confidence", "det_id"], 60.0, [False, True]).select("frame_id", "det_id")


@query(
    _D + "SELECT frame_id, det_id, CASE WHEN class_id = 1 THEN 2 ELSE 1 END AS category, CASE WHEN class_id = 1 THEN "
    "'ball' ELSE 'player' END AS name, CASE WHEN class_id = 1 THEN 0 END AS decoded, 'frame_' || CASE WHEN "
    "frame_id < 1000000 THEN lpad(CAST(frame_id AS VARCHAR), 6, '0') ELSE CAST(frame_id AS VARCHAR) END || '.jpg' "
    "AS file_name FROM det"
)
def label_maps(spark, d):
    det = detections(spark, d)
    name = L.class_name(F.when(F.col("class_id") == 1, 37).otherwise(0))
    return det.select(
        "frame_id",
        "det_id",
        L.coco_category(name).alias("category"),
        name.alias("name"),
        L.decode_model_label(F.col("class_id")).alias("decoded"),
        L.frame_name(F.col("frame_id")).alias("file_name")
    )
