"""Tables that stand in for detections, positions, frames, tracks and metrics, derived from the test tables.

Each function has the same table as SQL in ``SQL``, for comparison with another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Order of the rows of one frame; no two rows of a frame agree in all of them.
ROW_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, frame_id, det_id, class_id (0 player, 1 ball), confidence, x, y, w, h, ts."""
    d = lambda c: F.col(c).cast("double")
    li = table(spark, sf_dir, "lineitem")
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ROW_ORDER)).cast("long")
    return li.select(
        F.lit(0).cast("long").alias("match_id"),
        F.col("l_orderkey").alias("frame_id"),
        number.alias("det_id"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("class_id"),
        F.round(F.lit(1.0) - F.lit(8) * F.col("l_discount"), 4).alias("confidence"),
        ((F.col("l_partkey") * 37) % 1920).cast("double").alias("x"),
        ((F.col("l_suppkey") * 53) % 1080).cast("double").alias("y"),
        (F.lit(100.0) + F.lit(10) * d("l_quantity")).alias("w"),
        (F.lit(100.0) + F.lit(6) * d("l_quantity")).alias("h"),
        (F.col("l_orderkey") * F.lit(2.0)).alias("ts"),
    )


def positions(det: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """det with the box centre mapped to the pitch, from a confidence on."""
    return det.filter(F.col("confidence") >= min_confidence).withColumns({
        "px": (F.col("x") + F.col("w") / 2) / 1920.0 * 105.0 - 52.5,
        "py": (F.col("y") + F.col("h") / 2) / 1080.0 * 68.0 - 34.0,
    })


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, event_id, n (the track's update number), y, ts: one track for each user of ``events``."""
    ev = table(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return ev.select(F.col("user_id").alias("track_id"), "event_id", n.alias("n"), F.col("value").alias("y"), "ts")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, metric, step, value."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value")


SQL = {
    "det": """det AS (SELECT CAST(0 AS BIGINT) AS match_id, l_orderkey AS frame_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS det_id,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS class_id,
  round(CAST(1.0 AS DOUBLE) - 8 * l_discount, 4) AS confidence,
  CAST((l_partkey * 37) % 1920 AS DOUBLE) AS x, CAST((l_suppkey * 53) % 1080 AS DOUBLE) AS y,
  CAST(100.0 AS DOUBLE) + 10 * l_quantity AS w, CAST(100.0 AS DOUBLE) + 6 * l_quantity AS h,
  l_orderkey * CAST(2.0 AS DOUBLE) AS ts FROM lineitem)""",
    "pos": """pos AS (SELECT *, (x + w / 2) / CAST(1920.0 AS DOUBLE) * CAST(105.0 AS DOUBLE) - CAST(52.5 AS DOUBLE) AS px,
  (y + h / 2) / CAST(1080.0 AS DOUBLE) * CAST(68.0 AS DOUBLE) - CAST(34.0 AS DOUBLE) AS py FROM det WHERE confidence >= 0.5)""",
    "frames": """balls AS (SELECT frame_id, max_by(px, det_id) AS ball_x, max_by(py, det_id) AS ball_y FROM pos WHERE class_id = 1 GROUP BY frame_id),
  frames AS (SELECT f.frame_id, f.ts, f.n_players, b.ball_x, b.ball_y FROM (SELECT frame_id, min(ts) AS ts, count(*) AS n_players FROM pos WHERE class_id = 0 GROUP BY frame_id) f LEFT JOIN balls b ON b.frame_id = f.frame_id)""",
    "prev": """pairs AS (SELECT *, lag(frame_id) OVER (ORDER BY frame_id) AS prev_frame, lag(ts) OVER (ORDER BY frame_id) AS prev_ts,
  lag(ball_x) OVER (ORDER BY frame_id) AS prev_x, lag(ball_y) OVER (ORDER BY frame_id) AS prev_y FROM frames),
  moves AS (SELECT *, CASE WHEN ts - prev_ts <= 0 THEN 0 ELSE sqrt((ball_x - prev_x) * (ball_x - prev_x) + (ball_y - prev_y) * (ball_y - prev_y)) / (ts - prev_ts) END AS speed FROM pairs)""",
    "tracks": """tracks AS (SELECT user_id AS track_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n, value AS y, ts FROM events)""",
    "metrics": """metrics AS (SELECT user_id AS run, event_type AS metric, event_id AS step, value FROM events)""",
}


def sql(*views: str) -> str:
    return "WITH " + ",\n".join(SQL[v] for v in views)
