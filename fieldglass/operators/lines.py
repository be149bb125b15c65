"""Line segments of a frame: tests, touchlines, crossings, corners."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import line_walk
from .walk import dealt, made_alike


def length() -> Column:
    return G.distance("x1", "y1", "x2", "y2")


def is_horizontal(slope: float = 0.5) -> Column:
    """Rising by less than ``slope`` of the way along."""
    return F.abs(F.col("y2") - F.col("y1")) < F.abs(F.col("x2") - F.col("x1")) * slope


def is_vertical(degrees: float = 10.0) -> Column:
    """Within so many degrees of upright."""
    angle = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    return F.abs(F.abs(angle) - 90) < degrees


def straight(segments: DataFrame, width: float, height: float, share: float = 0.2) -> DataFrame:
    """Segments over ``share`` of the image's smaller side, with ``kind``: horizontal or vertical; others go."""
    kind = F.when(is_horizontal(), "horizontal").when(is_vertical(), "vertical")
    return segments.filter(length() > min(width, height) * share).withColumn("kind", kind).filter("kind IS NOT NULL")


def touchlines(segments: DataFrame, keys: list[str], line_id: str, width: float, height: float, edge: float = 0.15) -> DataFrame:
    """Two touchlines of each frame, with ``place`` 1 (upper) and 2.

    Of the four longest horizontal segments, those whose middle is near the upper or lower edge are taken if there are
    two or more of them, else all; the two upper ones of these are the touchlines. A frame with one segment has none.
    """
    flat = straight(segments, width, height).filter("kind = 'horizontal'").withColumns({"_length": length(), "_mid": (F.col("y1") + F.col("y2")) / 2})
    longest = flat.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_length").desc(), line_id))).filter("_n <= 4")
    near = (F.col("_mid") < height * edge) | (F.col("_mid") > height * (1 - edge))
    group = W.partitionBy(*keys)
    counted = longest.withColumns({"_near": near, "_all": F.count(F.lit(1)).over(group), "_edges": F.count_if(near).over(group)})
    chosen = counted.filter((F.col("_all") >= 2) & (F.col("_near") | (F.col("_edges") < 2)))
    place = F.row_number().over(group.orderBy("_mid", line_id))
    return chosen.withColumn("place", place).filter("place <= 2").select(*segments.columns, "place")


def grid_crossings(longitudinal: DataFrame, transversal: DataFrame, keys: list[str], line_id: str, width: float, height: float, extend: float = 1.5) -> DataFrame:
    """Where each longitudinal line of a frame meets each transversal one, within the image extended by a margin."""
    a, b = longitudinal.alias("a"), transversal.alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))

    def line(s: str) -> tuple[Column, Column, Column]:
        x1, y1, x2, y2 = (F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))
        return y2 - y1, x1 - x2, x2 * y1 - x1 * y2

    x, y = G.line_intersection(line("a"), line("b"))
    both = a.join(b, on).select(
        *[F.col(f"a.{k}") for k in keys],
        F.col(f"a.{line_id}").alias("i"),
        F.col(f"b.{line_id}").alias("j"),
        x.alias("x"),
        y.alias("y")
    )
    mx, my = width * (extend - 1) / 2, height * (extend - 1) / 2
    return both.filter(F.col("x").between(-mx, width + mx) & F.col("y").between(-my, height + my))


def with_lines(segments: DataFrame) -> DataFrame:
    """segments with a, b, c of their lines (unit normal); segments without length go."""
    a, b, c = G.segment_line("x1", "y1", "x2", "y2")
    return segments.withColumns({"a": a, "b": b, "c": c}).filter("a IS NOT NULL")


def _dealt_lines(segments: DataFrame, keys: list[str], line_id: str) -> DataFrame:
    """keys, line, a, b, c and the place (x, y) in the plane of distance and 500 times the angle, whole frames in the order of line numbers."""
    known = segments.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, F.col(line_id).cast("long").alias("line"), "x1", "y1", "x2", "y2")
    r, t = G.segment_polar("x1", "y1", "x2", "y2")
    return with_lines(dealt(known, keys, [F.col("line").asc_nulls_last()])).select(*keys, "line", "a", "b", "c", r.alias("x"), (t * 500.0).alias("y"))


def _arrays(pdf: pd.DataFrame, columns: str) -> list[np.ndarray]:
    return [pdf["line"].to_numpy(), *(pdf[c].to_numpy(float) for c in columns)]


def vanishing_points(segments: DataFrame, keys: list[str], line_id: str, trials: int = 200, near: float = 50.0) -> DataFrame:
    """keys, vx, vy, votes: the point that most of a frame's lines pass within ``near`` pixels of.

    Hypotheses are the crossings of pairs of lines, ``trials`` of a frame at most, chosen by a digest of their numbers, so
    that a result can be repeated. Each line votes for the hypotheses near it; the one with most votes (ties: the pair
    with the smallest numbers) is moved to where the sum of squared distances to its voters' lines is least. Frames are
    walked where their lines are, so that pairs and votes are never rows.
    """
    def rows(pdf: pd.DataFrame, at: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        votes, vx, vy = line_walk.points(*_arrays(pdf, "abc"), at, trials, near)
        of = np.flatnonzero(votes)
        return of, {"vx": vx[of], "vy": vy[of], "votes": votes[of]}

    return made_alike(_dealt_lines(segments, keys, line_id).drop("x", "y"), keys, rows, "vx double, vy double, votes long")


def merged_by_direction(
    segments: DataFrame, keys: list[str], line_id: str, near: float = 150.0, rho: float = 20.0, theta: float = 0.05, trials: int = 200, vote: float = 50.0
) -> DataFrame:
    """keys, longitudinal, line, a, b, c: lines merged from a frame's segments, those through its vanishing point apart from the others.

    The point is that of ``vanishing_points`` (``trials``, ``vote``), found in the same walk. Segments of a direction are
    one line if they are connected by steps within sqrt(rho ** 2 + (500 theta) ** 2) in the plane of distance and 500
    times the angle; its equation is their mean with a unit normal, its number their smallest.
    """
    def rows(pdf: pd.DataFrame, at: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        of, along, line, abc = _merged(pdf, at, near, rho, theta, trials, vote)
        return of, {"longitudinal": along, "line": line, **dict(zip("abc", abc, strict=True))}

    return made_alike(_dealt_lines(segments, keys, line_id), keys, rows, "longitudinal boolean, line long, a double, b double, c double")


def _merged(pdf: pd.DataFrame, at: np.ndarray, near: float, rho: float, theta: float, trials: int, vote: float) -> tuple:
    lines = _arrays(pdf, "abcxy")
    found = line_walk.points(*lines[:4], at, trials, vote)
    return line_walk.merged(*lines, at, found, near, (rho**2 + (500 * theta) ** 2) ** 0.5)


def line_keypoints(
    segments: DataFrame, keys: list[str], line_id: str, width: float, height: float, gap: float = 15.0, extend: float = 1.5,
    near: float = 150.0, rho: float = 20.0, theta: float = 0.05, trials: int = 200, vote: float = 50.0
) -> DataFrame:
    """keys, i, j, x, y: where a frame's merged longitudinal lines (i) meet its transversal ones (j).

    The whole line stage in one walk: vanishing point, two directions, merged lines, crossings within the image and a
    margin, each at least ``gap`` from those before it.
    """
    mx, my = width * (extend - 1) / 2, height * (extend - 1) / 2

    def rows(pdf: pd.DataFrame, at: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return line_walk.keypoints(*_merged(pdf, at, near, rho, theta, trials, vote), (-mx, width + mx, -my, height + my), gap)

    return made_alike(_dealt_lines(segments, keys, line_id), keys, rows, "i long, j long, x double, y double")


def unique_corners(points: Column, apart: float = 5.0) -> Column:
    """How many of a few points (x, y) have no earlier one nearer than ``apart``."""
    def alone(p: Column, i: Column) -> Column:
        return ~F.exists(F.slice(points, F.lit(1), i), lambda q: G.distance(p["x"], p["y"], q["x"], q["y"]) < apart)

    return F.size(F.filter(F.transform(points, alone), lambda x: x))


def two_corners(points: Column, apart: float = 5.0, origin: float = 10.0) -> Column:
    """struct(upper, lower) of the two distinct points away from the origin, or null if there aren't two."""
    placed = F.filter(points, lambda p: G.distance(p["x"], p["y"], F.lit(0.0), F.lit(0.0)) > origin)
    start = F.slice(placed, 1, 0)

    def add(kept: Column, p: Column) -> Column:
        far = F.forall(kept, lambda q: G.distance(p["x"], p["y"], q["x"], q["y"]) >= apart)
        return F.when(far, F.concat(kept, F.array(p))).otherwise(kept)

    two = F.aggregate(placed, start, add)
    a, b = F.get(two, F.lit(0)), F.get(two, F.lit(1))
    first = a["y"] <= b["y"]
    return F.when(F.size(two) == 2, F.struct(F.when(first, a).otherwise(b).alias("upper"), F.when(first, b).otherwise(a).alias("lower")))


#: Zones of the pitch (fixed values), bounds in any order.
ZONES = {
    "zone_14": (16.5, 0.0, -9.0, 9.0),
    "half_space_left": (0.0, -52.5, -34.0, -9.0),
    "half_space_right": (0.0, -52.5, 9.0, 34.0),
    "goal_area": (16.5, -16.5, -20.16, 20.16),
    "penalty_area": (16.5, -16.5, -30.34, 30.34),
}


def in_zones(x: str, y: str, zones: dict[str, tuple[float, float, float, float]] = ZONES) -> Column:
    """Names of the zones that hold a pitch point; bounds (x, x, y, y) may stand in either order."""
    at = [F.when(F.col(x).between(min(a, b), max(a, b)) & F.col(y).between(min(c, d), max(c, d)), F.lit(n)) for n, (a, b, c, d) in zones.items()]
    return F.array_compact(F.array(*at))
