"""Segments, touchlines, crossings, corners, scales, zones; and columns that no other query shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import detections, positions, sql, table
from ..functions import geometry as G
from ..functions import labels as L
from ..operators import calibration as K
from ..operators import cluster
from ..operators import datasets as D
from ..operators import lines as O
from ..registry import query
from .landmarks import _K, keypoints

_D, _P = sql("det"), sql("det", "pos")
r6 = lambda c: F.round(c, 6)
r3 = lambda c: F.round(c, 3)
_SEG = _D + """, seg AS (SELECT frame_id, det_id, x AS x1, y AS y1, x + CASE WHEN det_id % 2 = 1 THEN w ELSE w / 16 END AS x2, y + CASE WHEN det_id % 2 = 1 THEN h / 4 ELSE h END AS y2 FROM det),
  straight AS (SELECT *, len AS length, CASE WHEN abs(y2 - y1) < abs(x2 - x1) * 0.5 THEN 'horizontal' WHEN abs(abs(degrees(atan2(y2 - y1, x2 - x1))) - 90) < 10 THEN 'vertical' END AS kind FROM (SELECT *, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS len FROM seg) WHERE len > 216)"""


def segments(spark, d):
    """Odd detections as flat segments, even ones as steep ones."""
    odd = F.col("det_id") % 2 == 1
    x2 = F.col("x") + F.when(odd, F.col("w")).otherwise(F.col("w") / 16)
    y2 = F.col("y") + F.when(odd, F.col("h") / 4).otherwise(F.col("h"))
    return detections(spark, d).select("frame_id", "det_id", F.col("x").alias("x1"), F.col("y").alias("y1"), x2.alias("x2"), y2.alias("y2"))


@query(_SEG + " SELECT frame_id, det_id, kind FROM straight WHERE kind IS NOT NULL")
def straight_segments(spark, d):
    return O.straight(segments(spark, d), 1920, 1080).select("frame_id", "det_id", "kind")


@query(_SEG + """, flat AS (SELECT *, (y1 + y2) / 2 AS mid, row_number() OVER (PARTITION BY frame_id ORDER BY length DESC, det_id) AS n FROM straight WHERE kind = 'horizontal'),
  four AS (SELECT *, (mid < 162 OR mid > 918) AS near, count(*) OVER (PARTITION BY frame_id) AS of_all, count(*) FILTER (WHERE mid < 162 OR mid > 918) OVER (PARTITION BY frame_id) AS edges FROM flat WHERE n <= 4)
  SELECT frame_id, det_id, place FROM (SELECT frame_id, det_id, row_number() OVER (PARTITION BY frame_id ORDER BY mid, det_id) AS place FROM four WHERE of_all >= 2 AND (near OR edges < 2)) WHERE place <= 2""")
def touchlines(spark, d):
    """Two touchlines of each frame: long flat segments, near the edges if there are such."""
    return O.touchlines(segments(spark, d), ["frame_id"], "det_id", 1920, 1080).select("frame_id", "det_id", "place")


@query(_SEG + """, l AS (SELECT frame_id, det_id, kind, y2 - y1 AS a, x1 - x2 AS b, x2 * y1 - x1 * y2 AS c FROM straight),
  p AS (SELECT l.frame_id, l.det_id AS i, r.det_id AS j, (l.b * r.c - r.b * l.c) / (l.a * r.b - r.a * l.b) AS x, (r.a * l.c - l.a * r.c) / (l.a * r.b - r.a * l.b) AS y FROM l JOIN l r ON l.frame_id = r.frame_id AND l.kind = 'horizontal' AND r.kind = 'vertical')
  SELECT frame_id, i, j, round(x, 3) AS x, round(y, 3) AS y FROM p WHERE x BETWEEN -480 AND 2400 AND y BETWEEN -270 AND 1350""")
def grid_crossings(spark, d):
    """Flat lines by steep ones, within the image and a margin."""
    s = O.straight(segments(spark, d), 1920, 1080)
    out = O.grid_crossings(s.filter("kind = 'horizontal'"), s.filter("kind = 'vertical'"), ["frame_id"], "det_id", 1920, 1080)
    return out.select("frame_id", "i", "j", r3("x").alias("x"), r3("y").alias("y"))


@query(_D + """, l AS (SELECT frame_id, det_id, h / sqrt(h * h + w * w) AS a, -w / sqrt(h * h + w * w) AS b, ((x + w) * y - x * (y + h)) / sqrt(h * h + w * w) AS c FROM det),
  p AS (SELECT l.frame_id, l.det_id AS i, r.det_id AS j, l.a * r.b - r.a * l.b AS det, l.b * r.c - r.b * l.c AS nx, r.a * l.c - l.a * r.c AS ny FROM l JOIN l r ON l.frame_id = r.frame_id AND l.det_id < r.det_id)
  SELECT frame_id, i, j, CAST(floor((nx / det + 0.0037) * 100) AS BIGINT) AS x, CAST(floor((ny / det + 0.0037) * 100) AS BIGINT) AS y FROM p WHERE abs(det) >= 0.05""")
def line_pairs(spark, d):
    """Crossings of the boxes' diagonals in a frame that are not nearly parallel, in hundredths of a pixel."""
    a, b, c = G.segment_line(*G.to_corners("x", "y", "w", "h"))
    lines = detections(spark, d).select("frame_id", F.col("det_id").alias("line_id"), a.alias("a"), b.alias("b"), c.alias("c"))
    out = cluster.line_pairs(lines, ["frame_id"])
    ends = lines.select("frame_id", F.col("line_id").alias("i"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    others = lines.select("frame_id", F.col("line_id").alias("j"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    steep = out.join(ends, ["frame_id", "i"]).join(others, ["frame_id", "j"]).filter(
        F.abs(F.col("a1") * F.col("b2") - F.col("a2") * F.col("b1")) >= 0.05
    )
    cut = lambda c: F.floor((F.col(c) + 0.0037) * 100).alias(c)
    return steep.select("frame_id", "i", "j", cut("x"), cut("y"))


@query(_D + """, l AS (SELECT frame_id, count(*) AS n, avg(h / sqrt(h * h + w * w)) AS a, avg(-w / sqrt(h * h + w * w)) AS b, avg(((x + w) * y - x * (y + h)) / sqrt(h * h + w * w)) AS c FROM det GROUP BY frame_id)
  SELECT frame_id, round(a / sqrt(a * a + b * b), 6) AS a, round(b / sqrt(a * a + b * b), 6) AS b, round(c / sqrt(a * a + b * b), 3) AS c FROM l""")
def merged_lines(spark, d):
    """The mean line of each frame's diagonals, with a unit normal."""
    a, b, c = G.segment_line(*G.to_corners("x", "y", "w", "h"))
    lines = detections(spark, d).select("frame_id", a.alias("a"), b.alias("b"), c.alias("c"))
    return K.merged_lines(lines, ["frame_id"]).select("frame_id", r6("a").alias("a"), r6("b").alias("b"), r3("c").alias("c"))


_QUAD = "[struct_pack(x := x, y := y), struct_pack(x := x + w * (det_id % 2), y := y), struct_pack(x := x + w, y := y + h), struct_pack(x := x, y := y + h * (det_id % 3))]"


@query(_D + f""", q AS (SELECT frame_id, det_id, {_QUAD} AS p FROM det)
  SELECT frame_id, det_id, 1 + CASE WHEN d12 THEN 0 ELSE 1 END + CASE WHEN d13 OR d23 THEN 0 ELSE 1 END + CASE WHEN d14 OR d24 OR d34 THEN 0 ELSE 1 END AS corners
  FROM (SELECT frame_id, det_id, """ + ", ".join(f"sqrt((p[{i}].x - p[{j}].x) * (p[{i}].x - p[{j}].x) + (p[{i}].y - p[{j}].y) * (p[{i}].y - p[{j}].y)) < 5 AS d{i}{j}" for i, j in ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))) + " FROM q)")
def unique_corners(spark, d):
    """How many of four marked corners differ."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    quad = F.array(at(x, y), at(x + w * (F.col("det_id") % 2), y), at(x + w, y + h), at(x, y + h * (F.col("det_id") % 3)))
    return detections(spark, d).select("frame_id", "det_id", O.unique_corners(quad).alias("corners"))


@query(_P + """, g AS (SELECT frame_id % 40 AS g, count(*) AS n, max(py) - min(py) AS span FROM pos WHERE frame_id % 7 < 2 AND abs(py) < 12 GROUP BY ALL)
  SELECT g, round(CASE WHEN n >= 10 AND span > 0 AND span < 0.5 * 68.0::DOUBLE THEN 68.0::DOUBLE / span ELSE 1 END, 6) AS scale FROM g""")
def map_y_scale(spark, d):
    """What a narrow band of positions is stretched by."""
    pos = positions(detections(spark, d)).filter("frame_id % 7 < 2 AND abs(py) < 12")
    return pos.groupBy((F.col("frame_id") % 40).alias("g")).agg(r6(K.map_y_scale("py", 68.0)).alias("scale"))


#: A homography of the test table.
H = [0.055, 0.002, -50.0, 0.001, 0.061, -33.0, 0.0, 0.0001, 1.0]
_YP = "((0.001::DOUBLE * x + 0.061::DOUBLE * ({y}) - 33.0::DOUBLE) / (0.0 * x + 0.0001::DOUBLE * ({y}) + 1.0::DOUBLE))"


@query(_D + f""", c AS (SELECT frame_id, det_id, x, y, 60 + 2 * det_id * (frame_id % 60) AS r, CASE WHEN det_id % 3 > 0 THEN 0.4::DOUBLE + (frame_id % 23) / 10 END AS ws FROM det),
  f AS (SELECT *, (abs({_YP.format(y="y - r")} - {_YP.format(y="y")}) + abs({_YP.format(y="y + r")} - {_YP.format(y="y")})) / 2 AS found FROM c),
  s AS (SELECT *, CASE WHEN found > 0.1 THEN 9.15::DOUBLE / found ELSE 1.0 END AS circle FROM f),
  m AS (SELECT *, CASE WHEN ws IS NULL THEN circle WHEN abs(ws - 1) > 0.05 THEN 0.3::DOUBLE * circle + 0.7::DOUBLE * ws ELSE ws END AS mixed, 0.4::DOUBLE * circle + 0.6::DOUBLE * ws AS pair FROM s)
  SELECT frame_id, det_id, round(CASE WHEN NOT circle BETWEEN 0.5 AND 2 THEN CASE WHEN ws BETWEEN 0.5 AND 5 THEN ws END
    WHEN abs(circle - 1) > 0.05 THEN CASE WHEN found > 9.15 AND mixed < 1 THEN 1 / mixed * 1.5::DOUBLE WHEN found < 9.15 AND mixed > 1 THEN mixed * 1.3::DOUBLE ELSE mixed END
    WHEN pair BETWEEN 0.5 AND 5 AND abs(pair - 1) > 0.05 THEN pair WHEN NOT pair BETWEEN 0.5 AND 5 AND ws BETWEEN 0.5 AND 5 THEN ws ELSE 1 END, 6) AS scale FROM m""")
def circle_y_scale(spark, d):
    """Scales from circles of many sizes, beside widths of many kinds."""
    r = F.lit(60) + 2 * F.col("det_id") * (F.col("frame_id") % 60)
    ws = F.when(F.col("det_id") % 3 > 0, F.lit(0.4) + (F.col("frame_id") % 23) / 10)
    at = detections(spark, d).withColumns({"r": r.cast("double"), "ws": ws})
    return at.select("frame_id", "det_id", r6(K.circle_y_scale(H, "x", "y", "r", "ws")).alias("scale"))


@query(
    _D + "SELECT frame_id, n FROM (SELECT frame_id, row_number() OVER (PARTITION BY frame_id % 500 ORDER BY frame_id) "
    "AS n, count(*) OVER (PARTITION BY frame_id % 500) AS of_all FROM (SELECT DISTINCT frame_id FROM det)) WHERE n "
    "<= 10 AND of_all >= 10"
)
def first_frames(spark, d):
    """The first ten frames of each match (a five-hundredth of the frames), from which a homography is fitted."""
    f = detections(spark, d).select("frame_id", (F.col("frame_id") % 500).alias("match")).distinct()
    from pyspark.sql import Window as W

    out = K.first_frames(f, ["match"], "frame_id")
    return out.select("frame_id", F.row_number().over(W.partitionBy("match").orderBy("frame_id")).cast("long").alias("n"))


@query(_P + """, z(zone, x1, x2, y1, y2) AS (VALUES ('zone_14', 0.0, 16.5, -9.0, 9.0), ('half_space_left', -52.5, 0.0, -34.0, -9.0), ('half_space_right', -52.5, 0.0, 9.0, 34.0),
    ('goal_area', -16.5, 16.5, -20.16, 20.16), ('penalty_area', -16.5, 16.5, -30.34, 30.34))
  SELECT frame_id, det_id, zone FROM pos JOIN z ON px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2""")
def zones(spark, d):
    pos = positions(detections(spark, d))
    return pos.select("frame_id", "det_id", F.explode(O.in_zones("px", "py")).alias("zone"))


@query(_P + "SELECT frame_id, det_id FROM pos WHERE class_id <> 1 OR confidence >= 0.8")
def valid_balls_and_others(spark, d):
    """Sure balls, and everything that isn't a ball."""
    pos = positions(detections(spark, d))
    ball = F.col("class_id") == 1
    return pos.filter(ball & (F.col("confidence") >= 0.8)).unionByName(pos.filter(~ball)).select("frame_id", "det_id")


@query(
    _D + "SELECT f.o_orderkey AS frame_id, r.det_id FROM (SELECT DISTINCT o_orderkey FROM orders) f JOIN (SELECT "
    "frame_id, min(det_id) AS det_id FROM det GROUP BY frame_id) r ON r.frame_id = f.o_orderkey"
)
def first_results(spark, d):
    """The first result of each video frame."""
    frames = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id")).distinct()
    out = D.first_results(detections(spark, d).select("frame_id", "det_id", "x"), frames, "det_id")
    return out.select("frame_id", F.col("result.det_id").alias("det_id"))


@query(_D + """, a AS (SELECT l_orderkey % 2 AS source, l_orderkey AS image_id FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
  n AS (SELECT *, row_number() OVER (ORDER BY source, image_id) AS new_image_id FROM a), b AS (SELECT frame_id % 2 AS source, frame_id * 10 + det_id AS annotation_id, frame_id AS image_id FROM det)
  SELECT b.source, b.annotation_id, n.new_image_id, row_number() OVER (ORDER BY b.source, b.annotation_id) AS new_id FROM b JOIN n ON n.source = b.source AND n.image_id = b.image_id""")
def remapped_annotations(spark, d):
    """Two datasets merged: new ids of images, and of annotations that follow them."""
    det = detections(spark, d)
    source = (F.col("frame_id") % 2).alias("source")
    images = det.select(source, F.col("frame_id").alias("image_id")).distinct()
    annotations = det.select(source, (F.col("frame_id") * 10 + F.col("det_id")).alias("annotation_id"), F.col("frame_id").alias("image_id"))
    _, out = D.remapped(images, annotations)
    return out.select("source", "annotation_id", "new_image_id", "new_id")


def _sliced_sql() -> str:
    """NMS over boxes that are moved by their tile and cut at the image."""
    from .walk_sql import NMS

    moved = """moved AS (SELECT match_id, frame_id, det_id, class_id, confidence, ts, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM (SELECT *, least(greatest(x + tx, 0.0), 1920.0::DOUBLE) AS x1, least(greatest(y + ty, 0.0), 1080.0::DOUBLE) AS y1, least(greatest(x + tx + w, 0.0), 1920.0::DOUBLE) AS x2, least(greatest(y + ty + h, 0.0), 1080.0::DOUBLE) AS y2 FROM (SELECT *, (det_id % 3) * 320.0::DOUBLE AS tx, (det_id % 2) * 220.0::DOUBLE AS ty FROM det)))"""
    return NMS.replace(", o AS (", f", {moved}, o AS (", 1).replace("AS r FROM det WHERE", "AS r FROM moved WHERE", 1)


@query(_sliced_sql())
def sliced_predictions(spark, d):
    """Predictions of tiles as boxes of the image, without repeats."""
    tiles = {"tile_x": F.col("det_id") % 3 * 320.0, "tile_y": F.col("det_id") % 2 * 220.0}
    out = D.sliced_predictions(detections(spark, d).withColumns(tiles), 1920, 1080)
    return out.select("frame_id", "class_id", "det_id", "confidence")


@query(
    _D + """SELECT 'track' AS kind, frame_id, det_id FROM det WHERE class_id = 1 UNION ALL SELECT 'tag', frame_id, NULL FROM (SELECT DISTINCT frame_id FROM det WHERE class_id = 0)"""
)
def merged_tags(spark, d):
    """A merged annotation file that keeps its tags."""
    det = detections(spark, d)
    tags = det.filter("class_id = 0").select("frame_id").distinct()
    return D.merged_tags(det.filter("class_id = 1").select("frame_id", "det_id"), tags, keep_tags=True).select("kind", "frame_id", "det_id")


@query(_K + """, c AS (SELECT type, frame_id, count(*) AS n FROM k GROUP BY ALL)
  SELECT type, round(avg(n), 6) AS mean, median(n) AS median, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY type""")
def landmark_stats(spark, d):
    """Landmarks of each type in the frames that have any: the statistics document's rows."""
    c = keypoints(spark, d).groupBy("type", "frame_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return c.groupBy("type").agg(
        r6(F.avg(n)).alias("mean"),
        F.median(n).alias("median"),
        F.min(n).alias("least"),
        F.max(n).alias("most"),
        F.sum(n).alias("total")
    )


@query(_D + """SELECT frame_id, det_id, round((x + x + w) / 2, 6) AS cx, round((y + y + h) / 2, 6) AS cy, round((x / 1920 - 0.5) * 105, 6) AS nx, round((y / 1080 - 0.5) * 68, 6) AS ny,
  round(2 * 960.0::DOUBLE - x, 6) AS mirrored, round(abs(h * 100 - w * 50) / sqrt(h * h + w * w), 6) AS away FROM det""")
def plain_forms(spark, d):
    """Centre boxes, pitch points of normalized ones, mirrored points, distances from a line."""
    det = detections(spark, d)
    x1, y1, x2, y2 = G.to_corners("x", "y", "w", "h")
    cx, cy, _, _ = G.to_center_box(x1, y1, x2, y2)
    nx, ny = G.normalized_to_pitch(F.col("x") / 1920, F.col("y") / 1080)
    line = G.segment_line(x1, y1, x2, y2)
    away = G.point_line_distance(line, F.col("x") + 100, F.col("y") + 50)
    return det.select(
        "frame_id",
        "det_id",
        r6(cx).alias("cx"),
        r6(cy).alias("cy"),
        r6(nx).alias("nx"),
        r6(ny).alias("ny"),
        r6(G.mirror("x", 960.0)).alias("mirrored"),
        r6(away).alias("away")
    )


@query(_D + "SELECT frame_id, det_id, CASE WHEN class_id = 1 THEN 1 ELSE 0 END AS class FROM det")
def name_classes(spark, d):
    """Classes of names."""
    name = F.when(F.col("class_id") == 1, "ball").otherwise("player")
    return detections(spark, d).select("frame_id", "det_id", L.class_of(name).alias("class"))
