"""Box arithmetic of augmentations, distortion of landmarks, and forms that no other query shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import detections, positions, sql
from ..functions import geometry as G
from ..operators import calibration as K
from ..operators import datasets as D
from ..operators import robust as R
from ..registry import query

_D, _P = sql("det"), sql("det", "pos")
r6 = lambda c: F.round(c, 6)
_BOX = ["frame_id", "det_id"]


def _boxes(df):
    return df.select(*_BOX, *[r6(c).alias(c) for c in "xywh"])


@query(
    _D + "SELECT frame_id, det_id, round(x / 3, 6) AS x, round(y * 0.5::DOUBLE, 6) AS y, round(w / 3, 6) AS w, round(h "
    "* 0.5::DOUBLE, 6) AS h FROM det"
)
def resized_boxes(spark, d):
    return _boxes(D.resized(detections(spark, d), 1920, 1080, 640, 540))


@query(_D + """, c AS (SELECT frame_id, det_id, least(greatest(least(x + 0.25::DOUBLE * y, x + 0.25::DOUBLE * (y + h)), 0), 1920) AS x1, least(greatest(greatest(x + w + 0.25::DOUBLE * y, x + w + 0.25::DOUBLE * (y + h)), 0), 1920) AS x2, least(y, 1080) AS y1, least(y + h, 1080) AS y2 FROM det)
  SELECT frame_id, det_id, round(x1, 6) AS x, round(y1, 6) AS y, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h FROM c WHERE x2 > x1 AND y2 > y1""")
def warped_boxes(spark, d):
    """Boxes under a shear by a quarter."""
    return _boxes(D.warped(detections(spark, d), [[1.0, 0.25, 0.0], [0.0, 1.0, 0.0]], 1920, 1080))


@query(_D + """, p AS (SELECT DISTINCT frame_id, frame_id + 1 AS other FROM det WHERE frame_id % 4 = 0)
  SELECT frame_id, det_id, x, y, w, h FROM det WHERE frame_id IN (SELECT frame_id FROM p) UNION ALL SELECT p.frame_id, d.det_id, d.x * 0.5::DOUBLE, d.y * 2.0::DOUBLE, d.w * 0.5::DOUBLE, d.h * 2.0::DOUBLE FROM p JOIN det d ON d.frame_id = p.other""")
def mixed_boxes(spark, d):
    """Every fourth frame with the scaled boxes of the next."""
    det = detections(spark, d)
    partners = det.filter("frame_id % 4 = 0").select("frame_id", (F.col("frame_id") + 1).alias("other")).distinct()
    return D.mixed_up(det, partners, 0.5, 2.0).select(*_BOX, *"xywh")


_CUT = "greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(_D + f""", o AS (SELECT * FROM det WHERE det_id % 2 = 0), n AS (SELECT a.* FROM det a WHERE a.det_id % 2 = 1 AND a.x + a.w <= 1920 AND a.y + a.h <= 1080 AND NOT EXISTS (SELECT 1 FROM o b WHERE b.frame_id = a.frame_id AND {_CUT} / (a.w * a.h + b.w * b.h - {_CUT}) > 0.1))
  SELECT frame_id, det_id, FALSE AS pasted FROM o UNION ALL SELECT frame_id, det_id, TRUE FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY det_id) AS rn FROM n) WHERE rn <= 2""")
def pasted_boxes(spark, d):
    """Even detections, and two odd ones that overlap none of them."""
    det = detections(spark, d)
    return D.pasted(det.filter("det_id % 2 = 0"), det.filter("det_id % 2 = 1"), 1920, 1080, 2).select(*_BOX, "pasted")


@query(_P + """, f AS (SELECT frame_id % 300 AS g, frame_id * 10 + det_id AS k, x, y, px * 12 AS px, py * 12 AS py, sqrt((x - 960) * (x - 960) + (y - 540) * (y - 540)) / (sqrt(1920.0::DOUBLE * 1920 + 1080 * 1080) / 2) > 0.7 AS far FROM pos),
  c AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE far) AS edge FROM f GROUP BY g),
  p AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(px) OVER w AS npx, lead(py) OVER w AS npy FROM f WHERE far WINDOW w AS (PARTITION BY g ORDER BY k)),
  r AS (SELECT g, avg(i / wd) AS ratio, count(*) AS pairs FROM (SELECT g, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) AS i, sqrt((px - npx) * (px - npx) + (py - npy) * (py - npy)) AS wd FROM p) WHERE wd > 0.1 GROUP BY g)
  SELECT c.g, coalesce(n >= 6 AND edge >= 3 AND pairs >= 2 AND ratio < 1.5, FALSE) AS distorted FROM c LEFT JOIN r ON r.g = c.g""")
def fisheye_groups(spark, d):
    """Which groups of landmarks look distorted at the edge."""
    pos = positions(detections(spark, d))
    pts = pos.select(
        (F.col("frame_id") % 300).alias("g"),
        (F.col("frame_id") * 10 + F.col("det_id")).alias("k"),
        "x",
        "y",
        (F.col("px") * 12).alias("px"),
        (F.col("py") * 12).alias("py")
    )
    return R.fisheye(pts, ["g"], "k", 1920, 1080, 1.5)


@query(_D + """, m AS (SELECT *, max(y) OVER (PARTITION BY frame_id % 50) AS largest FROM det), c AS (SELECT frame_id, det_id, CASE WHEN largest > 1 THEN 1080.0::DOUBLE ELSE 1 END AS unit, y / CASE WHEN largest > 1 THEN 1080.0::DOUBLE ELSE 1 END - 0.5::DOUBLE AS mid FROM m)
  SELECT frame_id, det_id, round((mid + 0.2::DOUBLE * mid * mid * mid + 0.5::DOUBLE) * unit, 6) AS y FROM c""")
def corrected_heights(spark, d):
    det = detections(spark, d).select(*_BOX, "y", (F.col("frame_id") % 50).alias("g"))
    return R.corrected_y(det, ["g"], "y", 1080.0).select(*_BOX, r6("y").alias("y"))


@query(_D + """, s AS (SELECT frame_id, det_id, sqrt(w * w + h * h) AS size, atan2(w, -h) AS theta, x * -h + y * w AS c FROM det)
  SELECT frame_id, det_id, round(c / size, 6) AS rho, round(CASE WHEN theta < 0 THEN theta + pi() ELSE theta END, 6) AS theta FROM s""")
def polar_segments(spark, d):
    """The boxes' diagonals as distance and angle."""
    rho, theta = G.segment_polar(*G.to_corners("x", "y", "w", "h"))
    return detections(spark, d).select(*_BOX, r6(rho).alias("rho"), r6(theta).alias("theta"))


@query(
    _D + "SELECT frame_id FROM (SELECT frame_id, count(*) FILTER (WHERE confidence > 0.6) AS green, count(*) AS pixels "
    "FROM det GROUP BY frame_id) WHERE green / pixels >= 0.5"
)
def gameplay_frames(spark, d):
    """Frames of which half or more is green (here: sure detections)."""
    f = detections(spark, d).groupBy("frame_id").agg(F.count_if(F.col("confidence") > 0.6).alias("green_pixels"), F.count(F.lit(1)).alias("pixels"))
    return K.gameplay(f).select("frame_id")


@query(
    _D + "SELECT frame_id, det_id, i, round(x + w * i / 4, 6) AS px, round(y + h * i / 4, 6) AS py FROM det CROSS JOIN "
    "(SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE frame_id % 10 = 3"
)
def diagonal_points(spark, d):
    """Five points of each box's diagonal, in a tenth of the frames."""
    det = detections(spark, d).filter("frame_id % 10 = 3")
    at = det.select(*_BOX, F.posexplode(G.line_points(*G.to_corners("x", "y", "w", "h"), 5)).alias("i", "p"))
    return at.select(*_BOX, "i", r6("p.x").alias("px"), r6("p.y").alias("py"))


@query(
    "SELECT k, x, y FROM (SELECT l_orderkey AS k, (l_orderkey % 40) * 50 AS width, (l_orderkey % 30) * 60 AS "
    "height FROM (SELECT DISTINCT l_orderkey FROM lineitem)) s, LATERAL (SELECT DISTINCT unnest([(width // 2 - "
    "320), 0, greatest(0, width - 640), 0, greatest(0, width - 640)]) AS x0, unnest([(height // 2 - 320), 0, 0, "
    "greatest(0, height - 640), greatest(0, height - 640)]) AS y0, unnest([0, 1, 1, 1, 1]) AS corner) t, LATERAL "
    "(SELECT greatest(0, x0) AS x, greatest(0, y0) AS y) u WHERE corner = 0 OR (width > 960 AND height > 960) "
    "GROUP BY ALL"
)
def corner_tiles(spark, d):
    """The centre and corner tiles of images of many sizes."""
    k = detections(spark, d).select(F.col("frame_id").alias("k")).distinct()
    tiles = G.corner_tiles((F.col("k") % 40) * 50, (F.col("k") % 30) * 60)
    return k.select("k", F.explode(tiles).alias("t")).select("k", F.col("t.x").cast("long").alias("x"), F.col("t.y").cast("long").alias("y"))
