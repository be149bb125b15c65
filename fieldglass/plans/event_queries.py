"""Events between frames, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import detections, positions, sql
from ..functions import labels as L
from ..operators import frames as O
from ..registry import query

_E = sql("det", "pos", "frames", "prev")
_COLS = "match_id, id, type, start_frame, end_frame, player, round(confidence, 6) AS confidence, ts_start, ts_end"


def _event_sql(kind: str, where: str, join: str, near: str, order: str, confidence: str) -> str:
    return f"""{_E}, near AS (SELECT m.*, p.det_id AS player, sqrt((p.px - m.prev_x) * (p.px - m.prev_x) + (p.py - m.prev_y) * (p.py - m.prev_y)) AS d_prev,
  sqrt((p.px - m.ball_x) * (p.px - m.ball_x) + (p.py - m.ball_y) * (p.py - m.ball_y)) AS d_now
  FROM moves m JOIN pos p ON p.class_id = 0 AND p.frame_id = m.{join} WHERE {where}),
  best AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY {order}) AS rn FROM near WHERE {near}),
  {kind} AS (SELECT CAST(0 AS BIGINT) AS match_id, '{kind}_' || frame_id AS id, '{kind}' AS type, prev_frame AS start_frame, frame_id AS end_frame, player, {confidence} AS confidence, prev_ts AS ts_start, ts AS ts_end FROM best WHERE rn = 1)
  SELECT {_COLS} FROM {kind}"""


def _rounded(ev):
    return ev.withColumn("confidence", F.round("confidence", 6)).drop("start_location", "end_location")


def _pos(spark, d):
    return positions(detections(spark, d))


PASS = _event_sql("pass", "m.speed >= 5 AND m.prev_x IS NOT NULL", "prev_frame", "d_prev < 3", "d_prev, player", "least(1.0, speed / 20)")
DRIBBLE = _event_sql("dribble", "TRUE", "frame_id", "d_prev < 10 AND d_now < 10", "player", "CAST(0.7 AS DOUBLE)")
SHOT = _event_sql(
    "shot",
    "m.speed >= 5 AND abs(m.ball_x) > 42.5",
    "prev_frame",
    "TRUE AND d_prev IS NOT NULL",
    "d_prev, player",
    "least(1.0, speed / 25)"
)
RECOVERY = _event_sql("recovery", "TRUE", "frame_id", "d_now < 5 AND d_prev > 5", "player", "CAST(0.8 AS DOUBLE)")


@query(PASS)
def event_pass(spark, d):
    pos = _pos(spark, d)
    return _rounded(O.passes(O.moves(O.frames(pos))))


@query(DRIBBLE)
def event_dribble(spark, d):
    pos = _pos(spark, d)
    return _rounded(O.dribbles(O.moves(O.frames(pos)), reach=10.0))


@query(SHOT)
def event_shot(spark, d):
    pos = _pos(spark, d)
    return _rounded(O.shots(O.moves(O.frames(pos)), speed=5.0, goal_x=42.5))


@query(RECOVERY)
def event_recovery(spark, d):
    pos = _pos(spark, d)
    return _rounded(O.recoveries(O.moves(O.frames(pos)), reach=5.0))


def _all(spark, d):
    return O.all_events(_pos(spark, d), dribbles_reach=10.0, shots_speed=5.0, shots_goal_x=42.5, recoveries_reach=5.0)


def _body(s: str) -> str:
    """The query's own views, behind those that all share."""
    return s[len(_E) :].rpartition("SELECT " + _COLS)[0]


def _union() -> str:
    parts, names = [], ["pass", "dribble", "shot", "recovery"]
    for kind, s in zip(names, (PASS, DRIBBLE, SHOT, RECOVERY), strict=True):
        parts.append(
            _body(s).rstrip().replace("near AS", f"near_{kind} AS").replace(
                "FROM near ",
                f"FROM near_{kind} "
            ).replace("best AS", f"best_{kind} AS").replace("FROM best ", f"FROM best_{kind} ").replace(
                f"{kind} AS (SELECT CAST(0",
                f"ev_{kind} AS (SELECT CAST(0"
            )
        )
    return _E + "".join(parts) + ", ev AS (" + " UNION ALL ".join(f"SELECT * FROM ev_{k}" for k in names) + ") "


@query(_union() + f"SELECT {_COLS} FROM ev")
def events_all(spark, d):
    """All four kinds; a frame may have several."""
    return _rounded(_all(spark, d))


_AT = "SELECT e.id, round(m.prev_x, 6) AS start_x, round(m.prev_y, 6) AS start_y, round(m.ball_x, 6) AS end_x, round(m.ball_y, 6) AS end_y FROM ev e JOIN moves m ON m.frame_id = e.end_frame"


@query(_union() + _AT)
def event_locations(spark, d):
    """Where the ball was before and at each event."""
    r = lambda c: F.round(c, 6)
    ev = _all(spark, d)
    return ev.select(
        "id",
        r("start_location.x").alias("start_x"),
        r("start_location.y").alias("start_y"),
        r("end_location.x").alias("end_x"),
        r("end_location.y").alias("end_y")
    )


@query(_union() + """SELECT count(*) AS total, count(*) FILTER (WHERE type = 'pass') AS passes, count(*) FILTER (WHERE type = 'shot') AS shots,
  count(*) FILTER (WHERE type = 'dribble') AS dribbles, count(*) FILTER (WHERE type = 'recovery') AS recoveries FROM ev""")
def event_counts(spark, d):
    """Dashboard counts by type, with zeros."""
    n = lambda k: F.count_if(F.col("type") == k)
    return _all(spark, d).agg(
        F.count(F.lit(1)).alias("total"),
        n("pass").alias("passes"),
        n("shot").alias("shots"),
        n("dribble").alias("dribbles"),
        n("recovery").alias("recoveries")
    )


@query(
    _union() + "SELECT type, count(*) AS n, count(DISTINCT end_frame) AS frames_with, round(avg(confidence), 6) AS "
    "mean_confidence FROM ev GROUP BY type"
)
def event_summary(spark, d):
    """The periodic checkpoint's numbers: frames with events, by type."""
    return _all(spark, d).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("end_frame").alias("frames_with"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


@query(_E + """SELECT frame_id, ts AS timestamp, det_id AS object_id, CAST(-1 AS BIGINT) AS team_id, round(px, 6) AS x_pitch, round(py, 6) AS y_pitch, 'movement' AS event_type, CASE WHEN confidence = 0 THEN 1.0 ELSE confidence END AS confidence FROM pos WHERE class_id = 0 AND frame_id IN (SELECT frame_id FROM frames)
  UNION ALL SELECT frame_id, ts, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), round(ball_x, 6), round(ball_y, 6), 'movement', CAST(1.0 AS DOUBLE) FROM frames WHERE ball_x IS NOT NULL""")
def frame_csv_rows(spark, d):
    """Rows of the frame table: players, then the ball with its sentinels."""
    pos = _pos(spark, d)
    fr = O.frames(pos)
    none = F.lit(-1).cast("long")
    kind = L.csv_event_type(F.lit(None).cast("string")).alias("event_type")
    players = pos.filter("class_id = 0").join(fr.select("frame_id"), "frame_id", "left_semi")
    players = players.select(
        "frame_id",
        F.col("ts").alias("timestamp"),
        F.col("det_id").alias("object_id"),
        none.alias("team_id"),
        F.round("px", 6).alias("x_pitch"),
        F.round("py", 6).alias("y_pitch"),
        kind,
        L.csv_confidence(F.col("confidence")).alias("confidence")
    )
    balls = fr.filter("ball_x IS NOT NULL").select(
        "frame_id",
        F.col("ts").alias("timestamp"),
        none.alias("object_id"),
        none.alias("team_id"),
        F.round("ball_x", 6).alias("x_pitch"),
        F.round("ball_y", 6).alias("y_pitch"),
        kind,
        L.csv_confidence(F.lit(None).cast("double")).alias("confidence")
    )
    return players.unionByName(balls)


@query(_E + "SELECT frame_id, prev_frame, round(speed, 6) AS speed FROM moves WHERE speed IS NOT NULL")
def ball_speed(spark, d):
    return O.moves(O.frames(_pos(spark, d))).filter("speed IS NOT NULL").select("frame_id", "prev_frame", F.round("speed", 6).alias("speed"))


@query(_E + "SELECT frame_id, n_players, round(ball_x, 6) AS ball_x, round(ball_y, 6) AS ball_y FROM frames")
def frame_table(spark, d):
    """Frames with players, with the last ball of each."""
    return O.frames(_pos(spark, d)).select("frame_id", "n_players", F.round("ball_x", 6).alias("ball_x"), F.round("ball_y", 6).alias("ball_y"))
