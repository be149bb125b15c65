"""Robust averages and teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import detections, positions, sql, table
from ..functions import geometry as G
from ..operators import robust as O
from ..registry import query

_D, _P = sql("det"), sql("det", "pos")
r6 = lambda c: F.round(c, 6)
_IQR = """q AS (SELECT cell, count(*) AS n, quantile_cont(x, 0.25) AS x1, quantile_cont(x, 0.75) AS x3, quantile_cont(y, 0.25) AS y1, quantile_cont(y, 0.75) AS y3 FROM c GROUP BY cell),
  i AS (SELECT c.*, q.n, x BETWEEN x1 - 1.5 * (x3 - x1) AND x3 + 1.5 * (x3 - x1) AND y BETWEEN y1 - 1.5 * (y3 - y1) AND y3 + 1.5 * (y3 - y1) AS inside FROM c JOIN q ON q.cell = c.cell),
  s AS (SELECT cell, count(*) FILTER (WHERE inside) AS kept FROM i GROUP BY cell),
  o AS (SELECT i.* FROM i JOIN s ON s.cell = i.cell WHERE n < 3 OR kept < n * 0.5 OR inside)"""
_C = _D + ", c AS (SELECT frame_id, det_id, det_id % 7 * 10 + class_id AS cell, x * x / 1920 AS x, y * y / 1080 AS y, confidence FROM det), " + _IQR


def _cells(spark, d):
    det = detections(spark, d)
    return det.select(
        "frame_id",
        "det_id",
        (F.col("det_id") % 7 * 10 + F.col("class_id")).alias("cell"),
        (F.col("x") * F.col("x") / 1920).alias("x"),
        (F.col("y") * F.col("y") / 1080).alias("y"),
        "confidence"
    )


@query(_C + " SELECT frame_id, det_id, cell FROM o")
def iqr_filter(spark, d):
    return O.without_outliers(_cells(spark, d), ["cell"]).select("frame_id", "det_id", "cell")


@query(
    _C + """ SELECT cell, round(median(x), 9) AS x, round(median(y), 9) AS y, count(*) AS n, round(CASE WHEN count(*) = 1 THEN any_value(confidence) * 0.7 ELSE greatest(0.1, least(1.0, avg(confidence) + least(0.25, count(*) / 15000.0 * 0.25) - least(0.3, (var_pop(x) + var_pop(y)) / 1e6 * 10))) END, 6) AS confidence FROM o GROUP BY cell"""
)
def robust_average(spark, d):
    """Medians and confidences of groups of points without outliers."""
    out = O.robust_average(O.without_outliers(_cells(spark, d), ["cell"]), ["cell"], 15000)
    return out.select("cell", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "n", r6("confidence").alias("confidence"))


@query(
    _D + "SELECT frame_id, round(sum(x * confidence) / sum(confidence), 6) AS x, round(sum(y * confidence) / "
    "sum(confidence), 6) AS y, round(sum(confidence), 6) AS weight FROM det WHERE confidence > 0 GROUP BY frame_id"
)
def weighted_centers(spark, d):
    out = O.weighted_center(detections(spark, d).filter("confidence > 0"), ["frame_id"], "confidence")
    return out.select("frame_id", r6("x").alias("x"), r6("y").alias("y"), r6("weight").alias("weight"))


_A, _B = [0.1, 0.2, 0.0, 0.1], [-0.1, 0.0, 0.2, -0.2]
_dist = lambda c: "sqrt(" + " + ".join(f"pow(embedding[{i + 1}]::DOUBLE - ({v}), 2)" for i, v in enumerate(c)) + ")"


@query(f"""WITH e AS (SELECT vec_id, (vec_id * 7 % 105) - 52.5 AS px, {_dist(_A)} AS da, {_dist(_B)} AS db FROM embeddings), m AS (SELECT *, least(da, db) AS dm FROM e)
  SELECT vec_id, CASE WHEN dm > 0.3 THEN NULL WHEN da <= db THEN 0 ELSE 1 END AS team_id, CASE WHEN dm <= 0.3 THEN 'PLAYER' WHEN abs(px) > 36 THEN 'GK' ELSE 'REF' END AS role, round(greatest(0.0, least(1.0, 1 - dm / 0.4)), 6) AS confidence FROM m""")
def team_assignment(spark, d):
    """Nearest of two team centres by the first four features; outliers are goalkeepers or referees."""
    e = table(spark, d, "embeddings").select(
        "vec_id",
        F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("f"),
        ((F.col("vec_id") * 7) % 105 - 52.5).alias("px")
    )
    t = O.assign_team(F.col("f"), [_A, _B], 0.2, F.col("px"))
    return e.withColumn("t", t).select("vec_id", "t.team_id", "t.role", r6("t.confidence").alias("confidence"))


@query(_P + """, n AS (SELECT frame_id, count(*) FILTER (WHERE confidence > 0.8) AS n FROM pos GROUP BY frame_id), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY frame_id % 50 ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
  SELECT frame_id, n, CASE WHEN before < 20 THEN 'train' ELSE 'assign' END AS phase FROM b""")
def golden_batch(spark, d):
    """Frames that train the team model: until twenty confident crops have come."""
    n = positions(detections(spark, d)).groupBy("frame_id").agg(
        F.count_if(F.col("confidence") > 0.8).alias("n")
    ).withColumn("run", F.col("frame_id") % 50)
    return O.golden_prefix(n, ["run"], "frame_id", "n").select("frame_id", "n", "phase")


@query(_P + """, l AS (SELECT frame_id, sqrt(pow(x - lead(x) OVER w, 2) + pow(y - lead(y) OVER w, 2)) AS i, sqrt(pow(px - lead(px) OVER w, 2) + pow(py - lead(py) OVER w, 2)) AS k FROM pos WINDOW w AS (PARTITION BY frame_id ORDER BY det_id))
  SELECT frame_id, round(avg(i / k), 6) AS ratio, count(*) AS pairs FROM l WHERE k > 0.1 GROUP BY frame_id""")
def spacing_ratio(spark, d):
    """Image against world spacing of consecutive points, by frame."""
    out = O.edge_spacing_ratio(positions(detections(spark, d)), ["frame_id"], "det_id")
    return out.select("frame_id", r6("ratio").alias("ratio"), "pairs")


@query(_P + """, e AS (SELECT frame_id % 20 AS run, abs(px - x / 1920 * 105 + 52.5) AS ex, abs(py - y / 1080 * 68 + 34) AS ey FROM pos)
  SELECT run, round(avg(ex), 6) AS mean_x, round(max(ey), 6) AS most_y, round(avg(ey) / avg(ex), 6) AS y_to_x, avg(ey) / avg(ex) > 1.5 AS skewed FROM e GROUP BY run""")
def mapping_errors(spark, d):
    """Mean and largest errors of a mapping, and whether y is off more than x."""
    sx, sy = G.pixel_to_pitch("x", "y")
    e = positions(detections(spark, d)).select(
        (F.col("frame_id") % 20).alias("run"),
        F.abs(F.col("px") - sx).alias("ex"),
        F.abs(F.col("py") - sy).alias("ey")
    )
    ratio = F.avg("ey") / F.avg("ex")
    return e.groupBy("run").agg(
        r6(F.avg("ex")).alias("mean_x"),
        r6(F.max("ey")).alias("most_y"),
        r6(ratio).alias("y_to_x"),
        (ratio > 1.5).alias("skewed")
    )


@query()
def team_centers(spark, d):
    """Two team centres by k-means, in ascending order, and the outlier threshold."""
    f = table(spark, d, "embeddings").select(F.col("embedding").alias("feature"))
    centers, limit = O.fit_teams(f)
    rows = ", ".join(f"({i}, {c[0]!r}D, {limit!r}D)" for i, c in enumerate(centers))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(team_id, first, threshold)")
