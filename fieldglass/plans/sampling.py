"""Scans, samples, set operations and dataset algebra."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import detections, metrics, sql, table
from ..functions import geometry as G
from ..operators import datasets as O
from ..registry import query

_D, _M = sql("det"), sql("metrics")
r6 = lambda c: F.round(c, 6)


def _frames(spark, d):
    return detections(spark, d).select("frame_id").distinct()


@query(_D + "SELECT DISTINCT frame_id FROM det WHERE frame_id % 30 = 0 ORDER BY frame_id LIMIT 100")
def strided_frames(spark, d):
    """Every thirtieth frame, a hundred at most."""
    return _frames(spark, d).filter("frame_id % 30 = 0").orderBy("frame_id").limit(100)


@query(
    _D + "SELECT frame_id FROM (SELECT frame_id, row_number() OVER (PARTITION BY frame_id % 10 ORDER BY frame_id) AS rn "
    "FROM (SELECT DISTINCT frame_id FROM det)) WHERE (rn - 1) % 25 = 0"
)
def strided_annotated(spark, d):
    """Every twenty-fifth annotated frame of each video."""
    f = _frames(spark, d).withColumn("video", F.col("frame_id") % 10)
    return O.strided(f, ["video"], "frame_id", 25).select("frame_id")


@query(
    _D + ", n AS (SELECT count(DISTINCT frame_id) AS n FROM det) SELECT DISTINCT CAST(least(i * greatest(1, (n - 1) // "
    "11), n - 1) AS BIGINT) AS at FROM n, range(12) r(i)"
)
def even_sample(spark, d):
    """Twelve evenly spaced positions."""
    return _frames(spark, d).agg(F.count(F.lit(1)).alias("n")).select(F.explode(O.evenly_spaced(F.col("n"), 12)).alias("at"))


@query(_D + "SELECT frame_id, det_id FROM det WHERE frame_id BETWEEN 500 AND 999")
def frame_range(spark, d):
    return detections(spark, d).filter(F.col("frame_id").between(500, 999)).select("frame_id", "det_id")


@query(_D + "SELECT frame_id FROM det WHERE frame_id % 2 = 0 INTERSECT SELECT frame_id FROM det WHERE frame_id % 3 = 0")
def common_frames(spark, d):
    f = detections(spark, d).select("frame_id")
    return f.filter("frame_id % 2 = 0").intersect(f.filter("frame_id % 3 = 0"))


@query(_D + "SELECT frame_id FROM det WHERE class_id = 0 EXCEPT SELECT frame_id FROM det WHERE class_id = 1")
def frames_without_ball(spark, d):
    det = detections(spark, d)
    return det.filter("class_id = 0").select("frame_id").subtract(det.filter("class_id = 1").select("frame_id"))


@query(
    _D + "SELECT a.frame_id, a.n AS n_a, b.n AS n_b FROM (SELECT frame_id, count(*) AS n FROM det WHERE frame_id % 2 = "
    "0 GROUP BY 1) a JOIN (SELECT frame_id, count(*) AS n FROM det WHERE frame_id % 3 = 0 GROUP BY 1) b ON "
    "a.frame_id = b.frame_id"
)
def runs_compared(spark, d):
    """Two runs side by side on the frames that both have."""
    n = lambda k, c: detections(spark, d).filter(F.col("frame_id") % k == 0).groupBy("frame_id").agg(F.count(F.lit(1)).alias(c))
    return n(2, "n_a").join(n(3, "n_b"), "frame_id")


@query(
    _D + ", q AS (SELECT frame_id, det_id, det_id % 4 AS k, x * 0.5 + (det_id % 4) % 2 * 960 AS x, y * 0.5 + (det_id % "
    "4) // 2 * 540 AS y, w * 0.5 AS w, h * 0.5 AS h FROM det) SELECT frame_id, det_id, x, y, w, h FROM q WHERE x "
    ">= 5 AND y >= 5 AND x + w <= 1915 AND y + h <= 1075 AND w >= 10 AND h >= 10"
)
def mosaic_boxes(spark, d):
    """Boxes of four images in one mosaic."""
    q = detections(spark, d).withColumn("quadrant", F.col("det_id") % 4)
    return O.mosaic(q, 1920, 1080, 1920, 1080, 5, 10).select("frame_id", "det_id", "x", "y", "w", "h")


@query(_D + "SELECT frame_id, det_id, CAST(1920 AS DOUBLE) - x - w AS x FROM det")
def flipped_boxes(spark, d):
    return O.mirrored(detections(spark, d), 1920.0).select("frame_id", "det_id", "x")


@query(_D + ", i AS (SELECT DISTINCT frame_id FROM det) SELECT frame_id, CAST(row_number() OVER (ORDER BY frame_id) AS BIGINT) AS image_id FROM i")
def image_ids(spark, d):
    """Running image numbers in frame order."""
    return O.dense_ids(_frames(spark, d), ["frame_id"], "image_id")


@query(
    _D + ", a AS (SELECT 'f' || frame_id AS file_name, 0 AS source, frame_id AS image_id FROM det WHERE frame_id % 2 = "
    "0), b AS (SELECT 'f' || frame_id AS file_name, 1 AS source, frame_id AS image_id FROM det WHERE frame_id % 3 "
    "= 0) SELECT DISTINCT * FROM a UNION ALL SELECT DISTINCT CASE WHEN file_name IN (SELECT file_name FROM a) THEN "
    "'second_' || file_name ELSE file_name END, source, image_id FROM b"
)
def merged_datasets(spark, d):
    """Two datasets under (source, image id), with clashing names prefixed."""
    named = lambda k: _frames(spark, d).filter(F.col("frame_id") % k == 0).select(F.concat(F.lit("f"), "frame_id").alias("file_name"), F.col("frame_id").alias("image_id"))
    return O.merge(named(2), named(3)).select("file_name", "source", "image_id")


@query(
    "SELECT o.o_orderkey AS image_id, count(l.l_orderkey) AS annotations FROM (SELECT DISTINCT o_orderkey FROM "
    "orders) o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey"
)
def image_annotations(spark, d):
    """Annotations of every image, none counted as 0."""
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id")).distinct()
    ann = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count(F.lit(1)).alias("n"))
    return images.join(ann, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("annotations"))


@query(_M + "SELECT metric, max_by(value, step) AS latest, max(step) AS step FROM metrics GROUP BY metric")
def latest_metrics(spark, d):
    return metrics(spark, d).groupBy("metric").agg(F.max_by("value", "step").alias("latest"), F.max("step").alias("step"))


@query(
    _D + "SELECT frame_id, det_id FROM (SELECT frame_id, det_id, count(*) OVER (PARTITION BY frame_id) AS n, "
    "row_number() OVER (PARTITION BY frame_id ORDER BY confidence DESC, det_id) AS rn FROM det) WHERE n <= 4 OR rn "
    "<= 4"
)
def capped_frames(spark, d):
    """The four best boxes of frames that have more."""
    w = W.partitionBy("frame_id").orderBy(F.col("confidence").desc(), "det_id")
    return detections(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 4").select("frame_id", "det_id")


@query(_D + "SELECT frame_id, det_id, w AS size FROM det ORDER BY w DESC, abs(x - 960), frame_id, det_id LIMIT 4")
def longest_four(spark, d):
    """The four widest boxes, ties to the middle."""
    return detections(spark, d).orderBy(
        F.col("w").desc(),
        F.abs(F.col("x") - 960),
        "frame_id",
        "det_id"
    ).limit(4).select("frame_id", "det_id", F.col("w").alias("size"))


@query(
    "WITH s AS (SELECT p_partkey AS id, 640 + p_partkey * 37 % 3000 AS w, 480 + p_partkey * 53 % 2000 AS h FROM "
    "part), xs AS (SELECT DISTINCT id, w, h, least(i * 512, greatest(0, w - 640)) AS x FROM s, range(8) r(i)), ys "
    "AS (SELECT DISTINCT id, least(i * 512, greatest(0, h - 640)) AS y FROM s, range(8) r(i)) SELECT xs.id, CAST(x "
    "AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM xs JOIN ys ON xs.id = ys.id"
)
def tile_grid(spark, d):
    """Overlapping tiles that cover images of many sizes."""
    s = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        (640 + F.col("p_partkey") * 37 % 3000).alias("w"),
        (480 + F.col("p_partkey") * 53 % 2000).alias("h")
    )
    return s.select("id", F.explode(G.tiles("w", "h")).alias("t")).select("id", "t.x", "t.y")


_SHUFFLED = "SELECT *, row_number() OVER (ORDER BY substr(md5(CAST(frame_id AS VARCHAR) || '-42'), 1, 8), frame_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT l_orderkey AS frame_id FROM lineitem)"


@query(f"SELECT frame_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS part FROM ({_SHUFFLED})")
def split_datasets(spark, d):
    """Train and validation parts of 80 and 20 % by count, in an order by a hash of the frame."""
    return O.split(_frames(spark, d), "frame_id")


@query(f"SELECT frame_id FROM ({_SHUFFLED}) WHERE rn <= 100")
def random_sample(spark, d):
    """A hundred frames by hash, in order."""
    return O.sample(_frames(spark, d), "frame_id", 100)
