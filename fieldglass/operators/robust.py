"""Robust averages, scales and teams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def y_scale(n: Column, span: Column, width: float = 68.0, least: int = 4) -> Column:
    """width / span where there are enough points and it is plausible; 1 within 5 %; else null."""
    k = F.lit(width) / F.when(span >= 1, span)
    return F.when((n >= least) & k.between(0.5, 15.0), F.when(F.abs(k - 1) > 0.05, k).otherwise(F.lit(1.0)))


def without_outliers(points: DataFrame, keys: list[str], parts: int = 16) -> DataFrame:
    """Points within 1.5 interquartile ranges of the quartiles in x and y.

    Groups under three points stay whole, as do groups that would lose more than half.
    """
    quart = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    q = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), quart("x").alias("_qx"), quart("y").alias("_qy"))
    inside = F.lit(True)
    for c in "xy":
        lo, hi = F.col(f"_q{c}")[0], F.col(f"_q{c}")[1]
        inside = inside & F.col(c).between(lo - 1.5 * (hi - lo), hi + 1.5 * (hi - lo))
    # a group is dealt in parts, each beside the group's figures: a few large groups are not a few tasks
    dealt = points.withColumn("_part", F.pmod(F.xxhash64(*points.columns), F.lit(parts)).cast("int"))
    beside = lambda g: g.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    at = dealt.join(beside(q), [*keys, "_part"]).withColumn("_in", inside)
    kept = at.groupBy(*keys, "_part").agg(F.count_if("_in").alias("_kept")).groupBy(*keys).agg(F.sum("_kept").alias("_kept"))
    whole = (F.col("_n") < 3) | (F.col("_kept") < F.col("_n") * 0.5)
    return at.join(beside(kept), [*keys, "_part"]).filter(whole | F.col("_in")).select(*points.columns)


def robust_average(points: DataFrame, keys: list[str], images: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Median point of each cluster, with a confidence raised by how often it was seen and lowered by its variance.

    A cluster of one keeps its confidence less 30 %. also: further columns whose medians are taken.
    """
    var = F.var_pop("x") + F.var_pop("y")
    many = F.avg("confidence") + F.least(F.lit(0.25), F.count(F.lit(1)) / images * 0.25) - F.least(F.lit(0.3), var / 1e6 * 10.0)
    conf = F.when(F.count(F.lit(1)) == 1, F.first("confidence") * 0.7).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), many)))
    middle = [F.median(c).alias(c) for c in ("x", "y", *also)]
    return points.groupBy(*keys).agg(*middle, conf.alias("confidence"), F.count(F.lit(1)).alias("n"))


def weighted_center(points: DataFrame, keys: list[str], weight: str) -> DataFrame:
    w = F.col(weight)
    return points.groupBy(*keys).agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in "xy"], F.sum(w).alias("weight"))


def assign_team(feature: Column, centers: list[list[float]], threshold: float, x: Column, origin: str = "center", clip: bool = True) -> Column:
    """struct(team_id, role, confidence, is_outlier) by the nearest centre.

    A feature over 1.5 thresholds from both is an outlier: a goalkeeper in a penalty box, else a referee. Without a
    feature: a player of no team with confidence 0.
    """
    def far(c):
        other = F.array(*[F.lit(float(v)) for v in c])
        return F.sqrt(F.aggregate(F.zip_with(feature, other, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))

    d = F.array(*[far(c) for c in centers])

    def verdict(d: Column) -> Column:
        least = F.array_min(d)
        out = least > threshold * 1.5
        conf = 1.0 - least / (threshold * 2.0)
        clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf))
        role = F.when(out & F.coalesce(G.in_penalty_box(x, origin), F.lit(False)), "GK").when(out, "REF").otherwise("PLAYER")
        return F.struct(
            F.when(~out, F.array_position(d, least).cast("int") - 1).alias("team_id"),
            role.alias("role"),
            (clipped if clip else F.when(out, conf).otherwise(clipped)).alias("confidence"),
            out.alias("is_outlier")
        )

    none = F.struct(
        F.lit(None).cast("int").alias("team_id"),
        F.lit("PLAYER").alias("role"),
        F.lit(0.0).alias("confidence"),
        F.lit(True).alias("is_outlier")
    )
    return F.when(feature.isNull(), none).otherwise(F.transform(F.array(d), verdict)[0])


def exact_percentile(values: DataFrame, name: str, share: float, bins: int = 4096) -> float | None:
    """The percentile of a column (linear between ranks, nulls left out), without holding all its different values.

    Values are counted in ``bins`` equal intervals; only those of the two intervals that the ranks fall in are looked at.
    """
    v = values.select(F.col(name).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n or low == high:
        return low
    place = F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / (high - low) * bins)).cast("int")
    counts = sorted(map(tuple, v.groupBy(place.alias("b")).count().collect()))
    rank = share * (n - 1)

    def at(r: int) -> float:
        before = 0
        for b, c in counts:
            if r < before + c:
                inside = (r - before) / (c - 1) if c > 1 else 0.0
                return v.filter(place == b).agg(F.percentile("v", inside)).first()[0]
            before += c

    lo = at(int(rank))
    return lo if rank == int(rank) else lo + (at(int(rank) + 1) - lo) * (rank - int(rank))


def fit_teams(features: DataFrame, k: int = 2, seed: int = 42) -> tuple[list[list[float]], float]:
    """Centres in ascending order and the 95th percentile of the distances to the nearest, from ``feature`` arrays."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = features.select(array_to_vector(F.col("feature").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=50).fit(data)
    centers = sorted([float(v) for v in c] for c in model.clusterCenters())
    dist = F.array_min(
        F.array(
            *[
                F.sqrt(
                    F.aggregate(
                        F.zip_with(F.col("feature").cast("array<double>"), F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)),
                        F.lit(0.0),
                        lambda s, v: s + v
                    )
                ) for c in centers
            ]
        )
    )
    return centers, exact_percentile(features.select(dist.alias("distance")), "distance", 0.95)


def golden_prefix(counts: DataFrame, key: list[str], order: str, n: str, enough: int = 20) -> DataFrame:
    """counts with ``phase``: ``train`` up to the row at which the running sum of n reaches ``enough``, then ``assign``."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum(n).over(W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("phase", F.when(before < enough, "train").otherwise("assign"))


def edge_spacing_ratio(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Mean ratio of image to world spacing between consecutive points, over pairs over 0.1 apart in the world."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order)
    at = points.withColumns(
        {
            "_i": G.distance("x", "y", F.lead("x").over(w), F.lead("y").over(w)),
            "_w": G.distance("px", "py", F.lead("px").over(w), F.lead("py").over(w))
        }
    )
    return at.filter(F.col("_w") > 0.1).groupBy(*keys).agg(F.avg(F.col("_i") / F.col("_w")).alias("ratio"), F.count(F.lit(1)).alias("pairs"))


def fisheye(points: DataFrame, keys: list[str], order: str, width: float, height: float, limit: float = 0.8) -> DataFrame:
    """A row for each group with ``distorted``: whether landmarks near the image's edge stand closer than on the pitch.

    Points over 0.7 of the way from the centre to a corner are at the edge. With fewer than 6 points, 3 at the edge, or 2
    pairs of these over 0.1 apart on the pitch, there is no distortion to tell.
    """
    far = G.distance("x", "y", F.lit(width / 2), F.lit(height / 2)) / (math.hypot(width, height) / 2) > 0.7
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.count_if(far).alias("at_edge"))
    ratios = edge_spacing_ratio(points.filter(far), keys, order)
    known = (F.col("points") >= 6) & (F.col("at_edge") >= 3) & (F.col("pairs") >= 2)
    return counts.join(ratios, keys, "left").select(*keys, F.coalesce(known & (F.col("ratio") < limit), F.lit(False)).alias("distorted"))


def corrected_y(points: DataFrame, keys: list[str], y: str, height: float, factor: float = 1.2) -> DataFrame:
    """points with y corrected by ``cubic_y``; whether a group's values are pixels follows from its largest."""
    largest = points.groupBy(*keys).agg(F.max(y).alias("_largest"))
    return points.join(largest, keys).withColumn(y, G.cubic_y(y, factor, "_largest", height)).drop("_largest")
