"""Per-frame and per-run statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import detections, metrics, positions, sql, table
from ..functions import geometry as G
from ..registry import query

_D, _P, _M = sql("det"), sql("det", "pos"), sql("metrics")
r6 = lambda c: F.round(c, 6)
_COUNTS = _D + ", c AS (SELECT frame_id, count(*) FILTER (WHERE class_id = 0) AS players, count(*) FILTER (WHERE class_id = 1) AS balls, count(*) AS n FROM det GROUP BY frame_id) "


def frame_counts_of(det):
    return det.groupBy("frame_id").agg(
        F.count_if(F.col("class_id") == 0).alias("players"),
        F.count_if(F.col("class_id") == 1).alias("balls"),
        F.count(F.lit(1)).alias("n")
    )


@query(_COUNTS + "SELECT * FROM c")
def frame_counts(spark, d):
    return frame_counts_of(detections(spark, d))


@query(
    _COUNTS + "SELECT o.o_orderkey AS frame_id, coalesce(c.players, 0) AS players, coalesce(c.balls, 0) AS balls FROM "
    "(SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN c ON c.frame_id = o.o_orderkey"
)
def frame_spine(spark, d):
    """Counts for every frame, with zeros for frames without detections."""
    spine = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id")).distinct()
    return spine.join(frame_counts_of(detections(spark, d)), "frame_id", "left").select(
        "frame_id",
        F.coalesce("players", F.lit(0)).alias("players"),
        F.coalesce("balls", F.lit(0)).alias("balls")
    )


@query(
    _COUNTS + "SELECT round(avg(players), 6) AS mean, median(players) AS median, min(players) AS least, max(players) AS "
    "most, round(stddev_pop(players), 6) AS std FROM c"
)
def frame_count_stats(spark, d):
    c = frame_counts_of(detections(spark, d))
    return c.agg(
        r6(F.avg("players")).alias("mean"),
        F.median("players").alias("median"),
        F.min("players").alias("least"),
        F.max("players").alias("most"),
        r6(F.stddev_pop("players")).alias("std")
    )


@query(
    _D + "SELECT class_id, round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS median, min(confidence) "
    "AS least, max(confidence) AS most FROM det GROUP BY class_id"
)
def confidence_stats(spark, d):
    return detections(spark, d).groupBy("class_id").agg(
        r6(F.avg("confidence")).alias("mean"),
        r6(F.median("confidence")).alias("median"),
        F.min("confidence").alias("least"),
        F.max("confidence").alias("most")
    )


@query(
    _COUNTS + "SELECT round(100.0 * count(*) FILTER (WHERE players > 0) / 20000, 4) AS with_players, round(100.0 * count(*) "
    "FILTER (WHERE balls > 0) / 20000, 4) AS with_balls, round(100.0 * count(*) FILTER (WHERE players > 0 AND "
    "balls > 0) / 20000, 4) AS with_both FROM c"
)
def coverage(spark, d):
    """Shares of the frames asked for, not of those read."""
    share = lambda c: F.round(F.count_if(c) * 100.0 / 20000, 4)
    p, b = F.col("players") > 0, F.col("balls") > 0
    return frame_counts_of(detections(spark, d)).agg(share(p).alias("with_players"), share(b).alias("with_balls"), share(p & b).alias("with_both"))


@query(_COUNTS + "SELECT n AS detections, count(*) AS frames FROM c GROUP BY n ORDER BY n")
def count_histogram(spark, d):
    return frame_counts_of(detections(spark, d)).groupBy(F.col("n").alias("detections")).agg(F.count(F.lit(1)).alias("frames")).orderBy("detections")


@query(
    "SELECT event_type, count(*) AS n, CAST(NULL AS BIGINT) AS user_id FROM events GROUP BY event_type UNION ALL "
    "SELECT NULL, count(*), user_id FROM events GROUP BY user_id UNION ALL SELECT NULL, count(*), NULL FROM events"
)
def counts_by_two(spark, d):
    """Counts by type, by user and in all, in one pass: grouping sets."""
    text = "SELECT event_type, count(*) AS n, user_id FROM {events} GROUP BY GROUPING SETS ((event_type), (user_id), ())"
    return spark.sql(text, events=table(spark, d, "events"))


@query(_P + """, f AS (SELECT frame_id, avg(CASE WHEN px BETWEEN -100 AND 100 AND py BETWEEN -250 AND 50 THEN 1.0 ELSE 0.0 END) AS valid, avg(CASE WHEN class_id = 0 AND det_id % 3 <> 0 THEN 1.0 ELSE 0.0 END) AS assigned FROM pos GROUP BY frame_id)
  SELECT round(avg(valid), 6) AS valid_rate, round(avg(assigned), 6) AS assigned_rate, count(*) AS frames FROM f""")
def rates_of_frames(spark, d):
    """Means over frames of per-frame rates."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    f = positions(detections(spark, d)).groupBy("frame_id").agg(
        F.avg(one(F.col("px").between(-100, 100) & F.col("py").between(-250, 50))).alias("valid"),
        F.avg(one((F.col("class_id") == 0) & (F.col("det_id") % 3 != 0))).alias("assigned")
    )
    return f.agg(r6(F.avg("valid")).alias("valid_rate"), r6(F.avg("assigned")).alias("assigned_rate"), F.count(F.lit(1)).alias("frames"))


@query(
    _P + "SELECT frame_id, round(min(px), 6) AS x_min, round(max(px), 6) AS x_max, round(max(py) - min(py), 6) AS y_range FROM pos GROUP BY frame_id"
)
def position_ranges(spark, d):
    return positions(detections(spark, d)).groupBy("frame_id").agg(
        r6(F.min("px")).alias("x_min"),
        r6(F.max("px")).alias("x_max"),
        r6(F.max("py") - F.min("py")).alias("y_range")
    )


@query(
    _P + "SELECT frame_id, count(*) FILTER (WHERE det_id % 3 = 1) AS team_0, count(*) FILTER (WHERE det_id % 3 = 2) AS "
    "team_1, count(*) FILTER (WHERE det_id % 3 = 0) AS unassigned FROM pos WHERE class_id = 0 GROUP BY frame_id"
)
def team_counts(spark, d):
    n = lambda k: F.count_if(F.col("det_id") % 3 == k)
    return positions(detections(spark, d)).filter("class_id = 0").groupBy("frame_id").agg(
        n(1).alias("team_0"),
        n(2).alias("team_1"),
        n(0).alias("unassigned")
    )


@query(_P + """, s AS (SELECT max(py) - min(py) AS span, count(*) AS n FROM pos WHERE class_id = 0), k AS (SELECT n, span, 68.0 / span AS k FROM s)
  SELECT n, round(span, 6) AS span, round(CASE WHEN n < 4 OR span < 1 OR k < 0.5 OR k > 15 THEN NULL WHEN abs(k - 1) > 0.05 THEN k ELSE 1.0 END, 6) AS y_scale FROM k""")
def y_scale(spark, d):
    """Scale that makes the players' range the pitch's width; null where there is too little to tell."""
    from ..operators.robust import y_scale as scale

    s = positions(detections(spark, d)).filter("class_id = 0").agg(F.count(F.lit(1)).alias("n"), (F.max("py") - F.min("py")).alias("span"))
    return s.select("n", r6("span").alias("span"), r6(scale(F.col("n"), F.col("span"))).alias("y_scale"))


@query(
    _M + "SELECT run, metric, step, round(avg(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 19 PRECEDING AND "
    "CURRENT ROW), 6) AS rolling FROM metrics"
)
def rolling_mean(spark, d):
    w = W.partitionBy("run").orderBy("step").rowsBetween(-19, 0)
    return metrics(spark, d).select("run", "metric", "step", r6(F.avg("value").over(w)).alias("rolling"))


@query(
    _M + "SELECT run, step, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY step ROWS "
    "BETWEEN 9 PRECEDING AND CURRENT ROW) AS last_ten, max(step) OVER (PARTITION BY run ORDER BY step ROWS "
    "UNBOUNDED PRECEDING) AS latest FROM metrics"
)
def recent_counts(spark, d):
    """Counts over the last ten rows, and the running maximum."""
    w = W.partitionBy("run").orderBy("step")
    return metrics(spark, d).select(
        "run",
        "step",
        F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).over(w.rowsBetween(-9, 0)).alias("last_ten"),
        F.max("step").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("latest")
    )


@query(_M + "SELECT run, round(sum(value * (1 + step % 3)) / sum(1 + step % 3), 6) AS weighted FROM metrics GROUP BY run")
def weighted_loss(spark, d):
    n = 1 + F.col("step") % 3
    return metrics(spark, d).groupBy("run").agg(r6(F.sum(F.col("value") * n) / F.sum(n)).alias("weighted"))


_GOALS = "(VALUES ('click', 55.0), ('view', 60.0), ('purchase', 40.0), ('signup', 0.0)) AS g(metric, goal)"


@query(
    _M + f", m AS (SELECT metric, avg(value) AS value FROM metrics GROUP BY metric) SELECT m.metric, round(m.value, 6) "
    f"AS value, m.value >= g.goal AS met, CASE WHEN g.goal > 0 THEN round(least(100.0, m.value / g.goal * 100), 6) "
    f"ELSE 0.0 END AS progress FROM m JOIN (SELECT metric, CAST(goal AS DOUBLE) AS goal FROM {_GOALS}) g ON "
    f"g.metric = m.metric"
)
def goal_progress(spark, d):
    """Metrics against goals: met, and progress up to 100."""
    goals = spark.sql(
        f"SELECT metric, CAST(goal AS DOUBLE) AS goal FROM VALUES ('click', 55.0), ('view', 60.0), ('purchase', 40.0), "
        f"('signup', 0.0) AS g(metric, goal)"
    )
    m = metrics(spark, d).groupBy("metric").agg(F.avg("value").alias("value"))
    return m.join(F.broadcast(goals), "metric").select(
        "metric",
        r6("value").alias("value"),
        (F.col("value") >= F.col("goal")).alias("met"),
        F.when(F.col("goal") > 0, r6(F.least(F.lit(100.0), F.col("value") / F.col("goal") * 100))).otherwise(0.0).alias("progress")
    )


@query(
    _D + ", r AS (SELECT frame_id % 5 AS run, count(*) AS n, count(DISTINCT frame_id) AS frames FROM det GROUP BY 1) "
    "SELECT run, n, frames, round(n / frames, 6) AS per_frame FROM r"
)
def run_totals(spark, d):
    r = detections(spark, d).groupBy((F.col("frame_id") % 5).alias("run")).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("frame_id").alias("frames")
    )
    return r.select("run", "n", "frames", r6(G.ratio("n", "frames")).alias("per_frame"))


@query(
    _D + "SELECT class_id, count(*) AS n, min(x) AS x_min, max(x + w) AS x_max, min(confidence) AS least, count(*) "
    "FILTER (WHERE w <= 0 OR h <= 0) AS invalid FROM det GROUP BY class_id"
)
def label_diagnostics(spark, d):
    det = detections(spark, d)
    return det.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("x_min"),
        F.max(F.col("x") + F.col("w")).alias("x_max"),
        F.min("confidence").alias("least"),
        F.count_if((F.col("w") <= 0) | (F.col("h") <= 0)).alias("invalid")
    )


@query(
    _D + ", t AS (SELECT frame_id, CAST(floor(x / 480) AS BIGINT) AS type, count(*) AS n FROM det GROUP BY 1, 2) SELECT "
    "type, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, median(n) AS median, count(*) AS frames FROM t GROUP "
    "BY type"
)
def type_stats(spark, d):
    """Statistics by type over the frames in which the type occurs."""
    t = detections(spark, d).groupBy("frame_id", F.floor(F.col("x") / 480).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("type").agg(
        F.sum("n").alias("total"),
        r6(F.avg("n")).alias("mean"),
        F.median("n").alias("median"),
        F.count(F.lit(1)).alias("frames")
    )
