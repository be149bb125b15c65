"""Frames, their predecessors and the events between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels as L


def frames(pos: DataFrame) -> DataFrame:
    """A row for each frame with a player: ts, n_players, ball_x, ball_y (the frame's last ball, or null), players."""
    ball, last = F.col("class_id") == 1, F.struct("det_id", "px", "py")
    player = F.struct(F.col("det_id").alias("player"), F.col("px").alias("x"), F.col("py").alias("y"))
    g = pos.groupBy("match_id", "frame_id").agg(
        F.min(F.when(~ball, F.col("ts"))).alias("ts"),
        F.count_if(~ball).alias("n_players"),
        F.max(F.when(ball, last)).alias("b"),
        F.array_sort(F.collect_list(F.when(~ball, player))).alias("players"),
    )
    return g.filter("n_players > 0").select(
        "match_id", "frame_id", "ts", "n_players", F.col("b.px").alias("ball_x"), F.col("b.py").alias("ball_y"), "players"
    )


def with_previous(df: DataFrame, keys: list[str], order: str, columns: dict[str, str], width: int = 100_000) -> DataFrame:
    """df with the columns of the row before in ``order`` among equal keys, under the new names.

    The order is cut into intervals of ``width``, so that one long match is many tasks; an interval's first row gets
    the last row of the nearest interval before that has any.
    """
    b = F.floor(F.col(order) / width)
    cut = df.withColumn("_b", b)
    row = F.struct(*columns)
    inside = cut.withColumn("_p", F.lag(row).over(W.partitionBy(*keys, "_b").orderBy(order)))
    ends = cut.groupBy(*keys, "_b").agg(F.max_by(row, order).alias("_last"))
    ends = ends.select(*keys, "_b", F.lag("_last").over(W.partitionBy(*keys).orderBy("_b")).alias("_before"))
    p = F.coalesce("_p", "_before")
    return inside.join(ends, [*keys, "_b"]).select(*df.columns, *[p[c].alias(n) for c, n in columns.items()])


def running_sums(df: DataFrame, keys: list[str], order: str, columns: dict[str, str], width: int = 100_000) -> DataFrame:
    """df with the sums of the columns over the rows up to this one in ``order`` among equal keys, under the new names.

    As in with_previous, the order is cut into intervals, whose totals are summed in a table with a row for each.
    """
    b = F.floor(F.col(order) / width)
    cut = df.withColumn("_b", b)
    within = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = cut.withColumns({f"_{n}": F.sum(c).over(within) for c, n in columns.items()})
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t{n}") for c, n in columns.items()])
    totals = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_t{n}") for n in columns.values()])
    return inside.join(totals, [*keys, "_b"]).select(*df.columns, *[(F.col(f"_{n}") + F.col(f"_t{n}")).alias(n) for n in columns.values()])


def moves(fr: DataFrame) -> DataFrame:
    """Frames with the previous frame, its ball and players, and the ball's speed since."""
    before = {"frame_id": "prev_frame", "ts": "prev_ts", "ball_x": "prev_x", "ball_y": "prev_y", "players": "prev_players"}
    at = with_previous(fr, ["match_id"], "frame_id", before)
    way = G.distance("ball_x", "ball_y", "prev_x", "prev_y")
    return at.withColumn("speed", G.velocity(way, F.col("ts") - F.col("prev_ts")))


def _reached(players: str) -> Column:
    """Players, each with the distances to the ball (now) and to its last place (was)."""
    def both(p: Column) -> Column:
        now, was = G.distance(p["x"], p["y"], "ball_x", "ball_y"), G.distance(p["x"], p["y"], "prev_x", "prev_y")
        return F.struct(was.alias("was"), p["player"].alias("player"), now.alias("now"))

    return F.transform(players, both)


def _nearest(players: Column, cond) -> Column:
    """The player nearest to the ball's last place among those that fulfil cond, or null."""
    return F.array_min(F.filter(players, cond))["player"]


def _earliest(players: Column, cond) -> Column:
    """The first player by number among those that fulfil cond, or null."""
    return F.array_min(F.transform(F.filter(players, cond), lambda p: p["player"]))


def _pass(speed: float = 5.0, reach: float = 3.0) -> tuple[str, Column, Column]:
    fast = (F.col("speed") >= speed) & F.col("prev_x").isNotNull()
    player = _nearest(_reached("prev_players"), lambda p: p["was"] < reach)
    return "pass", F.when(fast, player), L.event_confidence(F.lit("pass"), F.col("speed"))


def _dribble(reach: float = 2.0) -> tuple[str, Column, Column]:
    player = _earliest(_reached("players"), lambda p: (p["now"] < reach) & (p["was"] < reach))
    return "dribble", player, F.lit(0.7)


def _shot(speed: float = 15.0, goal_x: float = 47.5) -> tuple[str, Column, Column]:
    fast = (F.col("speed") >= speed) & (F.abs("ball_x") > goal_x)
    player = _nearest(_reached("prev_players"), lambda p: p["was"].isNotNull())
    return "shot", F.when(fast, player), L.event_confidence(F.lit("shot"), F.col("speed"))


def _recovery(reach: float = 1.0) -> tuple[str, Column, Column]:
    player = _earliest(_reached("players"), lambda p: (p["now"] < reach) & (p["was"] > reach))
    return "recovery", player, F.lit(0.8)


def _events(mv: DataFrame, kinds: list[tuple[str, Column, Column]]) -> DataFrame:
    """A row for each kind whose player isn't null, from one row for each frame."""
    found = [
        F.struct(F.lit(k).alias("type"), player.alias("player"), confidence.cast("double").alias("confidence")) for k, player, confidence in kinds
    ]
    e = mv.select("*", F.explode(F.filter(F.array(*found), lambda x: x["player"].isNotNull())).alias("e"))
    place = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return e.select(
        "match_id",
        F.concat_ws("_", "e.type", "frame_id").alias("id"),
        F.col("e.type").alias("type"),
        F.col("prev_frame").alias("start_frame"),
        F.col("frame_id").alias("end_frame"),
        F.col("e.player").alias("player"),
        F.col("e.confidence").alias("confidence"),
        F.col("prev_ts").alias("ts_start"),
        F.col("ts").alias("ts_end"),
        place("prev_x", "prev_y").alias("start_location"),
        place("ball_x", "ball_y").alias("end_location"),
    )


def passes(mv: DataFrame, speed: float = 5.0, reach: float = 3.0) -> DataFrame:
    """A fast ball that left the nearest player of the previous frame."""
    return _events(mv, [_pass(speed, reach)])


def dribbles(mv: DataFrame, reach: float = 2.0) -> DataFrame:
    """The first player who is near the ball in this frame and was near its last place."""
    return _events(mv, [_dribble(reach)])


def shots(mv: DataFrame, speed: float = 15.0, goal_x: float = 47.5) -> DataFrame:
    """A fast ball near a goal line, by the nearest player of the previous frame."""
    return _events(mv, [_shot(speed, goal_x)])


def recoveries(mv: DataFrame, reach: float = 1.0) -> DataFrame:
    """The first player near the ball who was not near its last place."""
    return _events(mv, [_recovery(reach)])


def all_events(pos: DataFrame, **radii: float) -> DataFrame:
    """All four kinds, by one pass over the frames; options are named by kind, as ``dribbles_reach``."""
    rules = {"passes": _pass, "dribbles": _dribble, "shots": _shot, "recoveries": _recovery}
    options = {k: {o.split("_", 1)[1]: v for o, v in radii.items() if o.startswith(k + "_")} for k in rules}
    return _events(moves(frames(pos)), [f(**options[k]) for k, f in rules.items()])
