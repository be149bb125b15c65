"""The pitch's landmarks as a table, and rules about detected keypoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed dimensions in metres.
PENALTY_DEPTH, PENALTY_WIDTH, AREA_DEPTH, AREA_WIDTH = 16.5, 40.32, 5.5, 18.32
SPOT, CIRCLE, ARC = 11.0, 9.15, 1.0


def landmark_table(spark: SparkSession, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """name, x, y, type, priority of the pitch's 42 landmarks, origin at its centre, by its symmetry."""
    hl, hw = length / 2, width / 2
    left_right, top_bottom = (("left", -1), ("right", 1)), (("top", -1), ("bottom", 1))
    rows: list[tuple[str, float, float, str, int]] = [
        ("center_point", 0.0, 0.0, "center_line", 1),
        ("center_circle_center", 0.0, 0.0, "center_circle", 1)
    ]
    for side, sx in left_right:
        gx = sx * hl
        rows += [
            (f"goal_{side}_center", gx, 0.0, "goal", 1),
            (f"penalty_spot_{side}", gx - sx * SPOT, 0.0, "penalty_spot", 2),
            (f"center_circle_{side}", sx * CIRCLE, 0.0, "center_circle", 2),
            (f"center_line_{side}", gx, 0.0, "center_line", 2),
            (f"touchline_{side}_midpoint", gx, 0.0, "touchline", 3),
            (f"goal_area_{side}_center", gx - sx * AREA_DEPTH / 2, 0.0, "goal_area", 3),
        ]
        for end, sy in top_bottom:
            cy = sy * hw
            rows += [
                (f"corner_{end}_{side}", gx, cy, "corner", 1),
                (f"penalty_box_{side}_{end}", gx - sx * PENALTY_DEPTH, sy * PENALTY_WIDTH / 2, "penalty_box", 2),
                (f"penalty_box_{side}_goal_{end}", gx, sy * PENALTY_WIDTH / 2, "penalty_box", 2),
                (f"goal_area_{side}_{end}", gx - sx * AREA_DEPTH, sy * AREA_WIDTH / 2, "goal_area", 2),
                (f"corner_arc_{end}_{side}_x", gx - sx * ARC, cy, "corner_arc", 3),
                (f"corner_arc_{end}_{side}_y", gx, cy - sy * ARC, "corner_arc", 3),
            ]
    for end, sy in top_bottom:
        rows += [(f"center_circle_{end}", 0.0, sy * CIRCLE, "center_circle", 2), (f"touchline_{end}_midpoint", 0.0, sy * hw, "touchline", 3)]
    values = ", ".join(f"('{n}', {x!r}D, {y!r}D, '{t}', {p})" for n, x, y, t, p in sorted(rows))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(name, x, y, type, priority)")


def plausible(kind: Column, x: Column, y: Column, px: Column, py: Column, w: float, h: float, length: float = 105.0, width: float = 68.0) -> Column:
    """Whether a keypoint's place in the image and on the pitch fits its type; types without a rule fit everywhere."""
    corner = ((x < w * 0.4) | (x > w * 0.6)) & ((y < h * 0.4) | (y > h * 0.6))
    to_corner = F.sqrt(F.pow(F.abs(px) - length / 2, 2) + F.pow(F.abs(py) - width / 2, 2))
    return (
        F.when(kind == "goal", ((x < w * 0.3) | (x > w * 0.7)) & (F.abs(y - h / 2) <= h * 0.3) & (F.abs(F.abs(px) - length / 2) <= 10))
        .when(kind == "center_line", (F.abs(y - h / 2) <= h * 0.2) & (F.abs(py) <= 2))
        .when(kind == "corner", corner & (to_corner <= 15))
        .when(kind == "penalty_box", F.abs(F.abs(px) - (length / 2 - PENALTY_DEPTH)) < 8)
        .when(kind == "center_circle", (F.sqrt(F.pow(x - w / 2, 2) + F.pow(y - h / 2, 2)) <= min(w, h) * 0.4) & (F.sqrt(px * px + py * py) <= 10))
        .otherwise(F.lit(True))
    )


def plausible_average(kind: Column, x: Column, y: Column, px: Column, py: Column, w: float, h: float, length: float = 105.0) -> Column:
    """As plausible, with the wider bounds for landmarks averaged over frames; false outside the image."""
    corner = ((x < w * 0.4) | (x > w * 0.6)) & ((y < h * 0.4) | (y > h * 0.6))
    fits = (
        F.when(kind == "goal", ((x < w * 0.35) | (x > w * 0.65)) & (F.abs(F.abs(px) - length / 2) <= 15))
        .when(kind == "corner", corner)
        .when(kind == "center_circle", (F.hypot(x - w / 2, y - h / 2) <= min(w, h) * 0.5) & (F.hypot(px, py) <= 15))
        .when(kind == "center_line", (F.abs(y - h / 2) <= h * 0.4) & (F.abs(py) <= 5))
        .otherwise(F.lit(True))
    )
    return x.between(0, w) & y.between(0, h) & fits


def plausible_goal(x: Column, y: Column, px: Column, py: Column, confidence: Column, w: float, h: float, length: float = 105.0, post: bool = False) -> Column:
    """Whether a goal's centre (or one of its posts) is where goals are, in the image and on the pitch; px of 0 counts as right.

    Posts may be lower or higher and on either side of the image; centres must be sure enough and on their side.
    """
    left = px < 0
    pitch = (F.abs(px - F.when(left, -length / 2).otherwise(length / 2)) <= 10) & (F.abs(py) <= 5)
    inside = x.between(0, w) & y.between(0, h) & pitch
    if post:
        return inside & y.between(h * 0.05, h * 0.95)
    side = F.when(left, x <= w * 0.4).otherwise(x >= w * 0.6)
    return inside & (confidence >= 0.5) & side & (F.abs(y - h / 2) <= h * 0.25)


def averaged(keypoints: DataFrame, keys: list[str], order: list[str], images: int, w: float, h: float) -> DataFrame:
    """keypoints(type, x, y, px, py, confidence) of one still camera averaged over ``images`` frames, by type and place.

    Points of a type within 50 pixels of a cluster's first are one landmark: the medians without outliers in the image.
    Clusters of two or more must fit their type; one of a single point stays with a lower confidence.
    """
    from . import cluster, robust

    group = [*keys, "type", "cluster"]
    found = cluster.leader_clusters(keypoints, [*keys, "type"], order, 50.0)
    out = robust.robust_average(robust.without_outliers(found, group), group, images, ("px", "py"))
    c = F.col
    return out.filter((c("n") == 1) | plausible_average(c("type"), c("x"), c("y"), c("px"), c("py"), w, h))


def validated(keypoints: DataFrame, w: float, h: float) -> DataFrame:
    """Keypoints inside the image; the confidence of those that don't fit their type is halved."""
    c = F.col
    ok = plausible(c("type"), c("x"), c("y"), c("px"), c("py"), w, h)
    return keypoints.filter(c("x").between(0, w) & c("y").between(0, h)).withColumn(
        "confidence",
        F.when(ok, c("confidence")).otherwise(c("confidence") * 0.5)
    )


def calibration_points(keypoints: DataFrame, keys: list[str], w: float, h: float, most: int = 20, least: int = 0) -> DataFrame:
    """The best keypoints of a group by type, reliability and confidence; input order breaks ties.

    Where ``most`` are fewer than ``least``, all are taken.
    """
    if most < least:
        most = 2**31
    from pyspark.sql import Window as W

    from ..functions import labels as L

    rank = L.priority(F.col("type"))
    rel = L.y_reliability(F.col("type"), F.col("confidence"), F.col("x"), F.col("y"), w, h)
    order = W.partitionBy(*keys).orderBy(rank, rel.desc(), F.col("confidence").desc(), "det_id")
    return keypoints.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
