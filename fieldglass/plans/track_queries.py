"""Track state, histories and trajectory fits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import detections, sql, tracks
from ..operators import tracks as O
from ..operators.datasets import dense_ids
from ..registry import query

_T, _D = sql("tracks"), sql("det")
r6 = lambda c: F.round(c, 6)


@query(
    _T + ", h AS (SELECT track_id, n, count(*) OVER w AS points, avg(y) OVER w AS mean, min(y) OVER w AS least FROM "
    "tracks WINDOW w AS (PARTITION BY track_id ORDER BY n ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT "
    "track_id, n, points, round(mean, 6) AS mean, least FROM h"
)
def track_history(spark, d):
    """Statistics over a track's last thirty points."""
    h = O.histories(tracks(spark, d), ["track_id"], "n")
    ys = F.transform("history", lambda p: p["y"])
    mean = F.aggregate(ys, F.lit(0.0), lambda a, v: a + v) / F.size("history")
    return h.select("track_id", "n", F.size("history").cast("long").alias("points"), r6(mean).alias("mean"), F.array_min(ys).alias("least"))


@query(
    _T + ", f AS (SELECT track_id, n, y FROM tracks WHERE n <= 5) SELECT track_id, round(regr_slope(y, n), 6) AS slope, "
    "round(regr_intercept(y, n), 6) AS intercept FROM f GROUP BY track_id HAVING count(*) = 5"
)
def first_slopes(spark, d):
    """Lines through the first five points of each track."""
    first = tracks(spark, d).filter("n <= 5").groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("n").alias("t"), "y"))).alias("p")
    ).filter(F.size("p") == 5)
    return first.withColumn("f", O.linear_fit(F.col("p"))).select("track_id", r6("f.slope").alias("slope"), r6("f.offset").alias("intercept"))


_PARABOLA = _T + """, f AS (SELECT track_id, CAST(n - 1 AS DOUBLE) AS t, y FROM tracks WHERE n <= 5), s AS (SELECT track_id, count(*) AS n, sum(t) AS t1, sum(t*t) AS t2, sum(t*t*t) AS t3, sum(t*t*t*t) AS t4, sum(y) AS y0, sum(t*y) AS y1, sum(t*t*y) AS y2, max(y) - min(y) AS span FROM f GROUP BY track_id HAVING count(*) = 5),
  k AS (SELECT *, t4*(t2*n-t1*t1) - t3*(t3*n-t1*t2) + t2*(t3*t1-t2*t2) AS det FROM s),
  c AS (SELECT track_id, span, (y2*(t2*n-t1*t1) - t3*(y1*n-t1*y0) + t2*(y1*t1-t2*y0))/det AS a, (t4*(y1*n-t1*y0) - y2*(t3*n-t1*t2) + t2*(t3*y0-y1*t2))/det AS b, (t4*(t2*y0-y1*t1) - t3*(t3*y0-y1*t2) + y2*(t3*t1-t2*t2))/det AS c FROM k)"""


@query(_PARABOLA + """
  SELECT f.track_id, round(avg(abs(y - (a*t*t + b*t + c))) / (any_value(span) + 1e-6), 6) AS residual FROM f JOIN c ON c.track_id = f.track_id GROUP BY f.track_id""")
def parabola_residuals(spark, d):
    """How far the first five points of each track are from a parabola."""
    first = tracks(spark, d).filter("n <= 5").groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("n").alias("t"), "y"))).alias("p")
    ).filter(F.size("p") == 5)
    return first.select("track_id", r6(O.parabola_residual(F.col("p"))).alias("residual"))


@query(
    _T + ", g AS (SELECT track_id, event_id, event_id // 40 AS tick FROM tracks), l AS (SELECT *, CASE WHEN tick - "
    "lag(tick) OVER w > 11 THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY track_id ORDER BY event_id)) "
    "SELECT track_id, event_id, CAST(sum(new) OVER (PARTITION BY track_id ORDER BY event_id ROWS UNBOUNDED "
    "PRECEDING) AS BIGINT) AS incarnation FROM l"
)
def incarnations(spark, d):
    """Tracks begin anew after a gap of more than eleven updates."""
    t = tracks(spark, d).select("track_id", "event_id", F.floor(F.col("event_id") / 40).alias("tick"))
    return O.incarnations(t, "track_id", "tick").select("track_id", "event_id", "incarnation")


@query(
    _T + ", s AS (SELECT track_id, n, sum(CASE WHEN y > 95 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY n "
    "ROWS UNBOUNDED PRECEDING) AS session FROM tracks) SELECT track_id, n, CAST(session AS BIGINT) AS session, "
    "CAST(row_number() OVER (PARTITION BY track_id, session ORDER BY n) AS BIGINT) AS tick FROM s"
)
def scene_sessions(spark, d):
    """Counters that restart at a scene cut."""
    s = O.sessions(tracks(spark, d), ["track_id"], "n", F.col("y") > 95)
    return s.select("track_id", "n", "session", F.row_number().over(W.partitionBy("track_id", "session").orderBy("n")).cast("long").alias("tick"))


@query(
    _T + "SELECT track_id, n, round(y - lag(y) OVER (PARTITION BY track_id ORDER BY n), 6) AS step, y > lag(y) OVER "
    "(PARTITION BY track_id ORDER BY n) AS up FROM tracks"
)
def track_steps(spark, d):
    w = W.partitionBy("track_id").orderBy("n")
    return tracks(spark, d).select("track_id", "n", r6(F.col("y") - F.lag("y").over(w)).alias("step"), (F.col("y") > F.lag("y").over(w)).alias("up"))


@query(
    _D + ", t AS (SELECT class_id, det_id AS track_id, count(*) AS boxes, min(frame_id) AS first_frame, max(frame_id) "
    "AS last_frame FROM det GROUP BY 1, 2) SELECT class_id, track_id, CAST(row_number() OVER (ORDER BY class_id, "
    "track_id) AS BIGINT) AS number, boxes, first_frame, last_frame FROM t WHERE boxes >= 3"
)
def track_table(spark, d):
    """Tracks renumbered by class and id, with their boxes; short ones are left out."""
    t = detections(spark, d).groupBy("class_id", F.col("det_id").alias("track_id")).agg(
        F.count(F.lit(1)).alias("boxes"),
        F.min("frame_id").alias("first_frame"),
        F.max("frame_id").alias("last_frame")
    ).filter("boxes >= 3")
    numbered = dense_ids(t.withColumn("_key", F.col("class_id") * 2**40 + F.col("track_id")), ["_key"], "number")
    return numbered.select("class_id", "track_id", "number", "boxes", "first_frame", "last_frame")


@query(_PARABOLA + """, rp AS (SELECT f.track_id, avg(abs(y - (a*t*t + b*t + c))) / (any_value(span) + 1e-6) AS rp FROM f JOIN c ON c.track_id = f.track_id GROUP BY f.track_id),
  xs AS (SELECT track_id, n, CAST(event_id AS DOUBLE) AS x FROM tracks WHERE n <= 5), l AS (SELECT track_id, regr_slope(x, n) AS slope, regr_intercept(x, n) AS start, max(x) - min(x) AS width FROM xs GROUP BY track_id HAVING count(*) = 5),
  rl AS (SELECT xs.track_id, avg(abs(x - (slope * n + start))) / (any_value(width) + 1e-6) AS rl FROM xs JOIN l ON l.track_id = xs.track_id GROUP BY xs.track_id)
  SELECT t.track_id, t.n, CASE WHEN t.n < 5 THEN 'pending' WHEN 0.7 * rp + 0.3 * rl < 0.15 THEN 'valid' ELSE 'noise' END AS status FROM tracks t LEFT JOIN rp ON rp.track_id = t.track_id LEFT JOIN rl ON rl.track_id = t.track_id""")
def ball_status(spark, d):
    """Ball tracks judged once at five points: pending, valid or noise."""
    t = tracks(spark, d).select("track_id", "n", F.col("event_id").cast("double").alias("x"), "y")
    return O.ball_verdicts(t, ["track_id"], "n").select("track_id", "n", "status")


def _scenes(spark, d):
    """Detections of one match, with a scene cut at each 250th frame number."""
    return detections(spark, d).withColumn("cut", F.col("frame_id") % 250 == 0)


@query()
def associated_tracks(spark, d):
    """Track ids by two-stage overlap association of one match, its scenes in parallel."""
    return O.associate(_scenes(spark, d), cut="cut").select("frame_id", "det_id", "track_id")


@query()
def validated_balls(spark, d):
    """Associated boxes, the balls' tracks judged by their trajectories."""
    return O.validated_balls(_scenes(spark, d), cut="cut", buffer=60).select("frame_id", "det_id", "track_id", "status")
