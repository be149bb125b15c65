"""Calibration in two passes, homographies from correspondences, fused goals, scene cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import cluster, landmarks, robust, walk
from .frames import running_sums, with_previous
from .walk import made


def homography_of(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> list[float] | None:
    """Nine numbers of the homography that takes (x, y) to (px, py), by least squares (DLT); null for under four points.

    Both sides are moved to their centre and scaled first, so that pixels and metres weigh alike.
    """
    if len(x) < 4:
        return None

    def norm(u, v):
        s = np.hypot(u - u.mean(), v - v.mean()).mean() or 1.0
        m = np.array([[1 / s, 0, -u.mean() / s], [0, 1 / s, -v.mean() / s], [0, 0, 1]])
        return m, m[0, 0] * u + m[0, 2], m[1, 1] * v + m[1, 2]

    (a, x, y), (b, px, py) = norm(x, y), norm(px, py)
    one, zero = np.ones(len(x)), np.zeros(len(x))
    rows = [np.stack([x, y, one, zero, zero, zero, -px * x, -px * y, -px], 1), np.stack([zero, zero, zero, x, y, one, -py * x, -py * y, -py], 1)]
    h = np.linalg.inv(b) @ np.linalg.svd(np.concatenate(rows))[2][-1].reshape(3, 3) @ a
    return (h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h).ravel().tolist()


def fit_homographies(points: DataFrame, key: str) -> DataFrame:
    """key, homography (nine numbers) from four or more correspondences x, y -> px, py of each key, by least squares (DLT)."""
    def fit(x, y, px, py) -> list[tuple]:
        h = homography_of(x, y, px, py)
        return [] if h is None else [(h,)]

    return made(points, [key], ["x", "y"], ["x", "y", "px", "py"], fit, f"{key} long, homography array<double>")


def consensus_homographies(points: DataFrame, key: str, ids: list[str], trials: int = 64, near: float = 1.0) -> DataFrame:
    """key, homography, votes from correspondences some of which may be wild.

    Each trial fits four points of a key, those with the least digests of trial and ``ids``, so that a result can be
    repeated; a point votes for a trial whose homography takes it within ``near`` metres of its place. The points that
    vote for the trial with most votes (ties: the first) are fitted together. Keys with fewer than four votes go.
    """
    tried = points.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    digest = F.md5(F.concat_ws("-", "trial", *ids).cast("binary"))
    turn = F.row_number().over(W.partitionBy(key, "trial").orderBy(digest, *ids))
    few = tried.withColumn("_turn", turn).filter("_turn <= 4").drop("_turn").withColumn("_of", F.col(key) * trials + F.col("trial"))
    fits = fit_homographies(few, "_of").withColumns({"_key": F.floor(F.col("_of") / trials), "trial": F.pmod("_of", F.lit(trials))})
    hx, hy = G.homography(F.col("homography"), "x", "y")
    off = G.distance(hx, hy, "px", "py")
    both = points.join(fits, points[key] == fits["_key"]).filter(off <= near)
    votes = both.groupBy(key, "trial").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(key).agg(F.max(F.struct("votes", (-F.col("trial")).alias("t"))).alias("_m"))
    best = best.select(F.col(key).alias("_best"), F.col("_m.votes").alias("votes"), (-F.col("_m.t")).alias("_trial")).filter("votes >= 4")
    inside = both.join(best, (both[key] == best["_best"]) & (both["trial"] == best["_trial"])).select(*points.columns)
    return fit_homographies(inside, key).join(best.select(F.col("_best").alias(key), "votes"), key)


def frozen_homographies(keypoints: DataFrame, frames: int = 10, w: float = 1920, h: float = 1080) -> DataFrame:
    """(match_id, homography, frozen_at): from the averaged landmarks of a match's first ``frames`` frames, for good.

    frozen_at is the last of these frames. A match with fewer frames or under four landmarks has no row.
    """
    first = first_frames(keypoints.select("match_id", "frame_id").distinct(), ["match_id"], "frame_id", frames)
    last = first.groupBy("match_id").agg(F.max("frame_id").alias("frozen_at"))
    points = landmarks.averaged(keypoints.join(first, ["match_id", "frame_id"]), ["match_id"], ["frame_id", "det_id"], frames, w, h)
    return fit_homographies(points, "match_id").join(last, "match_id")


def calibrated(det: DataFrame, homographies: DataFrame, frames: int = 15, least: int = 10, width: float = 68.0) -> DataFrame:
    """det(match_id, frame_id, x, y: points in the image) with px, py and ``model``: how they were mapped.

    First pass: frames before a match's freeze by the size of the image alone (``fallback``), the others by its
    homography (``frozen``). Second pass: if the height that the first ``frames`` frames span is off by over 5 %, all rows
    are mapped by the homography and stretched to the pitch's width (``refined``).
    """
    fx, fy = G.pixel_to_pitch("x", "y")
    at = det.join(homographies, "match_id", "left")
    hx, hy = G.homography(F.col("homography"), "x", "y")
    frozen = F.coalesce(F.col("frame_id") >= F.col("frozen_at"), F.lit(False))
    once = at.select(
        *det.columns, "homography", hx.alias("_hx"), hy.alias("_hy"), frozen.alias("_frozen"),
        F.when(frozen, hx).otherwise(fx).alias("px"), F.when(frozen, hy).otherwise(fy).alias("py"),
    )
    first = first_frames(det.select("match_id", "frame_id").distinct(), ["match_id"], "frame_id", frames)
    span = once.join(first, ["match_id", "frame_id"]).groupBy("match_id").agg(F.count("py").alias("n"), (F.max("py") - F.min("py")).alias("span"))
    k = robust.y_scale(F.col("n"), F.col("span"), width, least)
    scale = span.select("match_id", F.when(F.abs(k - 1) > 0.05, k).alias("scale"))
    out = once.join(scale, "match_id", "left")
    refined = F.col("scale").isNotNull() & F.col("homography").isNotNull()
    px, py = F.when(refined, F.col("_hx")).otherwise(F.col("px")), F.when(refined, F.col("_hy") * F.col("scale")).otherwise(F.col("py"))
    model = F.when(refined, "refined").when(F.col("_frozen"), "frozen").otherwise("fallback")
    return out.select(*det.columns, px.alias("px"), py.alias("py"), model.alias("model"))


def recalibrated(pos: DataFrame, frames: int = 15, least: int = 10, width: float = 68.0) -> DataFrame:
    """pos(match_id, frame_id, py, ...) with py on the scale that each match's first frames give.

    First pass: the range of py over the first ``frames`` frames. Second pass: all rows, if the scale is off by over 5 %.
    """
    n = first_frames(pos.select("match_id", "frame_id").distinct(), ["match_id"], "frame_id", frames)
    first = pos.join(n, ["match_id", "frame_id"])
    span = first.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), (F.max("py") - F.min("py")).alias("span"))
    scale = span.select("match_id", F.coalesce(robust.y_scale(F.col("n"), F.col("span"), width, least), F.lit(1.0)).alias("scale"))
    return pos.join(scale, "match_id", "left").withColumn("py", F.col("py") * F.coalesce("scale", F.lit(1.0))).drop("scale")


def histogram_change(a: Column, b: Column) -> Column:
    """1 less the correlation of two histograms; null if either is constant."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    dot = lambda x, y, mx, my: F.aggregate(F.zip_with(x, y, lambda p, q: (p - mx) * (q - my)), F.lit(0.0), lambda s, v: s + v)
    means = F.struct(mean(a).alias("a"), mean(b).alias("b"))

    def value(m):
        var = dot(a, a, m["a"], m["a"]) * dot(b, b, m["b"], m["b"])
        return 1.0 - dot(a, b, m["a"], m["b"]) / F.sqrt(F.when(var > 0, var))

    return F.transform(F.array(means), value)[0]


def scene_cuts(frames: DataFrame, keys: list[str], order: str, limit: float = 0.7) -> DataFrame:
    """frames(blue, green, red: histograms) with ``cut``: the mean change of the three since the last frame is over the limit."""
    at = with_previous(frames, keys, order, {c: f"_last_{c}" for c in ("blue", "green", "red")})
    change = sum((histogram_change(F.col(c), F.col(f"_last_{c}")) for c in ("blue", "green", "red")), F.lit(0.0)) / 3
    out = at.withColumn("change", change).withColumn("cut", F.coalesce(F.col("change") > limit, F.lit(False)))
    return out.select(*frames.columns, "change", "cut")


def brightest_colour(pixels: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """keys, r, g, b: the mean colour of the brightest ``share`` of a crop's pixels(b, g, r), at least one of them.

    Pixels are counted by their brightness (766 levels) before anything is ordered, so a crop is some hundred rows; the
    level at the cut counts with its mean colour.
    """
    level = (F.col("b") + F.col("g") + F.col("r")).alias("level")
    levels = pixels.groupBy(*keys, level).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "rgb"])
    crop = W.partitionBy(*keys)
    above = F.coalesce(F.sum("n").over(crop.orderBy(F.col("level").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    need = F.ceil(F.sum("n").over(crop) * share)
    cut = levels.withColumns({"need": need, "taken": F.greatest(F.lit(0), F.least(F.col("n"), need - above))})
    return cut.groupBy(*keys).agg(*[(F.sum(F.col(c) * F.col("taken")) / F.max("need")).alias(c) for c in "rgb"])


def gameplay(frames: DataFrame, least: float = 0.5) -> DataFrame:
    """Frames whose share of green pixels is large enough."""
    return frames.filter(F.col("green_pixels") / F.col("pixels") >= least)


def _weight(method: Column) -> Column:
    return F.when(method == "zero_shot", 3.0).when(method == "color", 2.0).otherwise(1.0)


def fused_goals(goals: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """goals(goal_id, method, x, y, px, confidence) fused within each side of a frame.

    Goals within 100 pixels of a cluster's running mean join it. The two best clusters of two or more goals are kept;
    with none before it in rank, one sure goal of the two better methods is. Fused goals within 20 pixels: the surest.
    """
    sided = goals.withColumn("side", F.when(F.col("px") < 0, "left").otherwise("right"))
    c = cluster.leader_clusters(sided, [*keys, "side"], ["goal_id"], 100.0, "mean")
    w = F.col("confidence") * _weight(F.col("method"))
    zero, color = F.max(F.when(F.col("method") == "zero_shot", 1).otherwise(0)), F.max(F.when(F.col("method") == "color", 1).otherwise(0))
    mean = F.avg("confidence")
    g = c.groupBy(*keys, "side", "cluster").agg(
        F.count(F.lit(1)).alias("n"), (
            F.sum(F.col("x") * w) / F.sum(w)
        ).alias("x"), (F.sum(F.col("y") * w) / F.sum(w)).alias("y"), F.max(_weight(F.col("method"))).alias("bonus"), mean.alias("mean"),
        F.least(F.lit(1.0), mean + F.least(F.lit(0.15), F.count(F.lit(1)) * 0.05) + zero * 0.15 + color * 0.1).alias("confidence"),
    ).filter("x IS NOT NULL")
    rank = W.partitionBy(*keys, "side").orderBy((F.col("bonus") * F.col("n") * F.col("mean")).desc(), "cluster")
    fits = (F.col("n") >= 2) | ((F.row_number().over(rank) == 1) & (F.col("bonus") > 1) & (F.col("mean") > 0.7))
    best = g.withColumn("ok", fits).filter("ok").withColumn(
        "rank",
        F.row_number().over(rank)
    ).filter("rank <= 2").withColumnRenamed("cluster", "number")
    apart = cluster.spaced(best, keys, ["confidence", "side", "number"], 20.0, [False, True, True])
    top = W.partitionBy(*keys).orderBy(F.col("confidence").desc(), "side", "number")
    return apart.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= most).select(*keys, "side", "x", "y", "n", "confidence")


def smoothed_goals(goals: DataFrame, match: str = "match_id", size: int = 10, block: int = 1000) -> DataFrame:
    """goals(frame_id, goal_id, x, y, px, confidence) averaged over the last ``size`` frames with goals, by side.

    Goals that lie within 50 pixels of a cluster's member join it; clusters of two or more give a mean whose weights
    grow with confidence and recency. A frame without such a cluster keeps its own goals (n is 1).

    Frames are dealt in blocks of ``block`` that also hold the frames just before, so a goal isn't copied for each frame
    that it counts in, and a long match is many tasks.
    """
    frames = goals.select(match, "frame_id").distinct().withColumn("one", F.lit(1))
    turns = running_sums(frames, [match], "frame_id", {"one": "turn"}).select(match, "frame_id", "turn")
    left = F.coalesce(F.col("px") < 0, F.lit(False))
    numbered = goals.select(match, "frame_id", "goal_id", left.alias("left"), "x", "y", "confidence").join(turns, [match, "frame_id"])
    own = F.floor(F.col("turn") / block)
    last = F.floor((F.col("turn") + (size - 1)) / block)
    dealt = numbered.withColumn("block", F.explode(F.sequence(own, last)))
    kind = goals.schema[match].dataType.simpleString()
    schema = f"`{match}` {kind}, frame_id long, side string, x double, y double, n long, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, at in walk.groups(batches, [match, "block"]):
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield _smoothed(pdf.iloc[a:b], match, size, block)

    ordered = dealt.repartition(match, "block").sortWithinPartitions(match, "block", "turn", "goal_id")
    return ordered.mapInPandas(run, schema)


def _smoothed(g: pd.DataFrame, match: str, size: int, block: int) -> pd.DataFrame:
    """Fused and own goals of the frames of one block, whose goals come by turn and goal_id."""
    mine = g["turn"].to_numpy() // block == g["block"].iloc[0]
    frames = g[mine].drop_duplicates("turn")
    turn, out, fused = frames["turn"].to_numpy(), [], np.zeros(len(frames), bool)
    for side, name in ((True, "left"), (False, "right")):
        s = g[g["left"].to_numpy() == side]
        at, x, y, conf = (s[c].to_numpy(float) for c in ("turn", "x", "y", "confidence"))
        start, stop = np.searchsorted(at, turn - (size - 1)), np.searchsorted(at, turn, "right")
        # as many windows at once as keep their table of goals small
        step = max(1, 2_000_000 // max(1, int((stop - start).max(initial=1))))
        for k in range(0, len(turn), step):
            w, *values = _window_means(x, y, conf, start[k : k + step], stop[k : k + step])
            fused[k + w] = True
            out.append(pd.DataFrame({"frame_id": frames["frame_id"].to_numpy()[k + w], "side": name, **dict(zip(("x", "y", "n", "confidence"), values, strict=True))}))
    alone = g[mine & ~np.isin(g["turn"].to_numpy(), turn[fused])]
    side = np.where(alone["left"].to_numpy(), "left", "right")
    out.append(alone[["frame_id", "x", "y", "confidence"]].assign(side=side, n=1))
    return pd.concat(out).assign(**{match: g[match].iloc[0]})[[match, "frame_id", "side", "x", "y", "n", "confidence"]]


def _window_means(x: np.ndarray, y: np.ndarray, conf: np.ndarray, start: np.ndarray, stop: np.ndarray, radius: float = 50.0) -> tuple[np.ndarray, ...]:
    """window, x, y, n, confidence of the clusters of two or more goals in the windows of rows from start to stop.

    Each goal joins the first cluster that has a member within the radius; all windows take their next goal at once.
    """
    size = stop - start
    most = int(size.max(initial=0))
    label, count = np.full((len(size), most), most), np.zeros((len(size), most + 1), np.int64)
    found, total = np.zeros(len(size), np.int64), [np.zeros((len(size), most)) for _ in range(5)]
    for p in range(most):
        w = np.flatnonzero(size > p)
        r = start[w] + p
        before = start[w][:, None] + np.arange(p)
        near = np.sqrt((x[before] - x[r][:, None]) ** 2 + (y[before] - y[r][:, None]) ** 2) < radius
        c = np.where(near, label[w, :p], most).min(1, initial=most)
        new = c == most
        c = np.where(new, found[w], c)
        found[w] += new
        label[w, p] = c
        count[w, c] += 1
        known = ~np.isnan(conf[r])
        v = np.where(known, conf[r] * count[w, c], 0.0)
        for t, add in zip(total, (v, v * x[r], v * y[r], np.where(known, conf[r], 0.0), known), strict=True):
            t[w, c] += add
    w, c = np.nonzero(count[:, :most] >= 2)
    weight, sx, sy, sure, known = (t[w, c] for t in total)
    with np.errstate(divide="ignore", invalid="ignore"):
        return w, sx / weight, sy / weight, count[w, c], np.minimum(1.0, sure / known * 1.1)


def merged_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Mean line (a, b, c) of each cluster with a unit normal."""
    m = lines.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in "abc"])
    n = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    n = F.when(n > 0, n)
    return m.select(*keys, *[(F.col(c) / n).alias(c) for c in "abc"])


def map_y_scale(y: str, height: float, least: int = 10, share: float = 0.5) -> Column:
    """Aggregate: what map heights are stretched by where ``least`` positions or more span less than ``share`` of the map."""
    span = F.max(y) - F.min(y)
    return F.when((F.count(y) >= least) & (span > 0) & (span < share * height), height / span).otherwise(1.0)


def circle_y_scale(h: list[float], cx: str, cy: str, r: str, width_scale: str, radius: float = 9.15) -> Column:
    """The y scale from a centre circle in the image and, where it is not null, from the pitch's width.

    The circle's radius on the pitch is measured upwards and downwards. A circle that is off by over 5 % counts 0.3
    beside an uneven width (0.7), and is widened further; else both count 0.4 and 0.6. Null: no scale can be trusted.
    """
    at = lambda x, y: G.homography(h, x, y)
    _, middle = at(F.col(cx), F.col(cy))
    _, top = at(F.col(cx), F.col(cy) - F.col(r))
    _, low = at(F.col(cx), F.col(cy) + F.col(r))
    found = (F.abs(top - middle) + F.abs(low - middle)) / 2
    circle = F.when(found > 0.1, radius / found).otherwise(1.0)
    width = F.col(width_scale)
    uneven, sane = F.abs(width - 1) > 0.05, width.between(0.5, 5.0)
    mixed = F.when(width.isNotNull() & uneven, 0.3 * circle + 0.7 * width).when(width.isNotNull(), width).otherwise(circle)
    widened = F.when((found > radius) & (mixed < 1), 1 / mixed * 1.5).when((found < radius) & (mixed > 1), mixed * 1.3).otherwise(mixed)
    both = 0.4 * circle + 0.6 * width
    near = F.when(both.between(0.5, 5.0) & (F.abs(both - 1) > 0.05), both).when(~both.between(0.5, 5.0) & sane, width)
    out = F.when(~circle.between(0.5, 2.0), F.when(sane, width))
    return out.when(F.abs(circle - 1) > 0.05, widened).otherwise(F.coalesce(near, F.lit(1.0)))


def first_frames(frames: DataFrame, keys: list[str], order: str, n: int = 10) -> DataFrame:
    """The first ``n`` frames of each match, from which its homography is fitted; none of a match with fewer.

    Each task ranks its own rows and passes on n of them for a match, so a long match isn't one task's work.
    """
    ranked = frames.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter(F.col("_n") <= n)
    full = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")).filter(F.col("_all") == n).select(*keys)
    return ranked.drop("_n").join(full, keys, "left_semi")
