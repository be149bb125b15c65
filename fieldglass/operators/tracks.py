"""Track state in batch: histories, incarnations, trajectory fits, verdicts, association."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import written
from . import walk
from .frames import running_sums, with_previous


def sessions(df: DataFrame, keys: list[str], order: str, cut: Column) -> DataFrame:
    """df with ``session``: how many cuts (scene changes) came up to the row."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("session", F.sum(F.when(cut, 1).otherwise(0)).over(w).cast("long"))


def incarnations(df: DataFrame, track: str | list[str], order: str, gap: int = 11) -> DataFrame:
    """df with ``incarnation``: a track that was away for more than ``gap`` updates begins anew."""
    w = W.partitionBy(*([track] if isinstance(track, str) else track)).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(
        "incarnation",
        F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long")
    ).drop("_new")


def histories(df: DataFrame, track: list[str], order: str, size: int = 30) -> DataFrame:
    """df with the last ``size`` points (t, y) of the track, the row's own included."""
    w = W.partitionBy(*track).orderBy(order).rowsBetween(-(size - 1), 0)
    return df.withColumn("history", F.collect_list(F.struct(F.col(order).alias("t"), F.col("y").alias("y"))).over(w))


def linear_fit(points: Column) -> Column:
    """struct(slope, offset) of y over t for an array of (t, y); null for fewer than two different t."""
    zero = F.lit(0.0)
    total = lambda f: F.aggregate(points, zero, lambda a, p: a + f(p))
    n = F.size(points).cast("double")
    st, sy = total(lambda p: p["t"].cast("double")), total(lambda p: p["y"])
    stt, sty = total(lambda p: p["t"].cast("double") * p["t"]), total(lambda p: p["t"].cast("double") * p["y"])
    den = n * stt - st * st
    slope = F.when(den != 0, (n * sty - st * sy) / den)
    return F.struct(slope.alias("slope"), ((sy - slope * st) / n).alias("offset"))


def parabola_residual(points: Column) -> Column:
    """Mean absolute distance of an array of (t, y) to its least-squares parabola, over the range of y; null if singular.

    Times count from the first point. The normal equations are solved in closed form.
    """
    t0 = points[0]["t"].cast("double")
    acc = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "t1", "t2", "t3", "t4", "y0", "y1", "y2")])

    def step(a, p):
        t, y = p["t"].cast("double") - t0, p["y"]
        return F.struct(
            (a["n"] + 1).alias("n"),
            (a["t1"] + t).alias("t1"),
            (a["t2"] + t * t).alias("t2"),
            (a["t3"] + t * t * t).alias("t3"),
            (a["t4"] + t * t * t * t).alias("t4"),
            (a["y0"] + y).alias("y0"),
            (a["y1"] + t * y).alias("y1"),
            (a["y2"] + t * t * y).alias("y2")
        )

    def solve(s):
        n, t1, t2, t3, t4, y0, y1, y2 = (s[k] for k in ("n", "t1", "t2", "t3", "t4", "y0", "y1", "y2"))
        det3 = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
        det = det3(t4, t3, t2, t3, t2, t1, t2, t1, n)
        ok = F.when(F.abs(det) > 1e-9, det)
        return F.struct(
            (det3(y2, t3, t2, y1, t2, t1, y0, t1, n) / ok).alias("a"),
            (det3(t4, y2, t2, t3, y1, t1, t2, y0, n) / ok).alias("b"),
            (det3(t4, t3, y2, t3, t2, y1, t2, t1, y0) / ok).alias("c")
        )

    def residual(f):
        err = F.aggregate(
            points,
            F.lit(0.0),
            lambda a, p: a + F.abs(
                p["y"] - (f["a"] * (p["t"].cast("double") - t0) * (p["t"].cast("double") - t0) + f["b"] * (p["t"].cast("double") - t0) + f["c"])
            )
        )
        ys = F.transform(points, lambda p: p["y"])
        return err / F.size(points) / (F.array_max(ys) - F.array_min(ys) + 1e-6)

    fit = F.transform(F.array(F.aggregate(points, acc, step)), solve)
    return F.transform(fit, residual)[0]


def line_residual(points: Column) -> Column:
    """As parabola_residual, for a straight line."""
    fit = F.transform(
        F.array(linear_fit(points)),
        lambda f: F.aggregate(points, F.lit(0.0), lambda a, p: a + F.abs(p["y"] - (f["slope"] * p["t"] + f["offset"])))
    )[0]
    ys = F.transform(points, lambda p: p["y"])
    return fit / F.size(points) / (F.array_max(ys) - F.array_min(ys) + 1e-6)


def ball_verdicts(df: DataFrame, track: list[str], order: str, least: int = 5, limit: float = 0.15) -> DataFrame:
    """df(x, y, ...) with ``status``: pending up to the point before the ``least``-th, then valid or noise for good.

    The verdict is made once, on the first ``least`` points: 0.7 of the parabola's residual in y and 0.3 of the line's
    in x under the limit; a fit that fails is noise.
    """
    w = W.partitionBy(*track).orderBy(order)
    n = df.withColumn("_n", F.row_number().over(w))
    pts = lambda c: F.array_sort(F.collect_list(F.when(F.col("_n") <= least, F.struct(F.col(order).alias("t"), F.col(c).alias("y")))))
    first = n.filter(F.col("_n") <= least).groupBy(*track).agg(F.count(F.lit(1)).alias("_k"), pts("x").alias("_xs"), pts("y").alias("_ys"))
    score = 0.7 * parabola_residual(F.col("_ys")) + 0.3 * line_residual(F.col("_xs"))
    first = first.select(
        *track,
        F.when(F.col("_k") >= least, F.when(F.coalesce(score < limit, F.lit(False)), "valid").otherwise("noise")).alias("_v")
    )
    return n.join(first, track, "left").withColumn("status", F.when(F.col("_n") < least, "pending").otherwise(F.col("_v"))).drop("_n", "_v")


def islands(det: DataFrame, match: str = "match_id", low: float = 0.1, buffer: int = 30, cut: str | None = None) -> DataFrame:
    """(match, frame_id, tick, session, island) of the frames that hold a box of confidence ``low`` or more.

    tick counts a match's frames with any box, as a tracker counts its updates; session counts the scene cuts up to the
    frame. No track lives over a cut, nor over more than ``buffer`` updates without such a box, so a new island begins
    there: islands can be tracked apart from each other. Counters run over intervals of frames, not over whole matches.
    """
    cuts = F.lit(0) if cut is None else F.max(F.coalesce(F.col(cut), F.lit(False)).cast("int"))
    live = F.max((F.coalesce(F.col("confidence"), F.lit(0.0)) >= low).cast("int"))
    fr = det.groupBy(match, "frame_id").agg(live.alias("live"), cuts.cast("long").alias("cut"), F.lit(1).cast("long").alias("one"))
    fr = running_sums(fr, [match], "frame_id", {"one": "tick", "cut": "session"}).filter("live = 1").select(match, "frame_id", "tick", "session")
    fr = with_previous(fr, [match], "frame_id", {"tick": "last_tick", "session": "last_session"})
    new = F.coalesce((F.col("tick") - F.col("last_tick") > buffer) | (F.col("session") != F.col("last_session")), F.lit(True))
    fr = fr.withColumn("new", new.cast("long")).drop("last_tick", "last_session")
    return running_sums(fr, [match], "frame_id", {"new": "island"}).drop("new")


def associate(
    det: DataFrame,
    match: str = "match_id",
    high: float = 0.5,
    low: float = 0.1,
    iou: float = 0.3,
    buffer: int = 30,
    cut: str | None = None
) -> DataFrame:
    """det with ``track_id``: two-stage IoU association, confident boxes first, then the rest with tracks left over.

    cut names a column that is true for boxes of a frame at which a new scene begins: open tracks end there. Islands of
    a match (see islands) are walked in parallel, each in frame order with its open tracks as the only state; track
    numbers count on from island to island, so they are those of one walk over the match. Boxes without a track are
    left out.
    """
    tracked = walked(det, islands(det, match, low, buffer, cut), match, high, low, iou, buffer)
    return tracked.select(*det.columns, "track_id")


def walked(det: DataFrame, frames: DataFrame, match: str, high: float, low: float, iou: float, buffer: int) -> DataFrame:
    """det with tick, session and track_id, from the islands of its frames."""
    at = frames.withColumnsRenamed({match: "_match", "frame_id": "_frame"})
    det = det.join(at, (det[match] == at["_match"]) & (det["frame_id"] == at["_frame"])).drop("_match", "_frame")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in det.schema.fields)}, number long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, trackers = None, Trackers(high, low, iou, buffer)
        for pdf, at in walk.groups(walk.larger(batches), [match, "island", "frame_id"]):
            box = pdf[["x", "y", "w", "h"]].to_numpy(float)
            conf, cls, tick = pdf["confidence"].to_numpy(), pdf["class_id"].to_numpy(), pdf["tick"].to_numpy()
            of = pdf[[match, "island"]].to_numpy()[at[:-1]]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]).any(1)
            new[0] = last is None or (of[0] != last).any()
            lane = np.cumsum(new) - new[0]
            trackers.begin(int(lane[-1]) + 1, bool(new[0]))
            last = of[-1]
            # step s: the frame number s of each island
            turn = np.arange(len(of)) - np.maximum.accumulate(np.where(new | (np.arange(len(of)) == 0), np.arange(len(of)), 0))
            order = np.argsort(turn, kind="stable")
            steps = np.searchsorted(turn[order], np.arange(turn.max() + 2))
            out = np.full(len(pdf), -1, np.int64)
            for a, b in zip(steps[:-1], steps[1:], strict=True):
                f = order[a:b]
                size = at[f + 1] - at[f]
                rows = np.repeat(at[f] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                out[rows] = trackers.frames(np.repeat(lane[f], size), box[rows], conf[rows], cls[rows], tick[rows])
            yield pdf.assign(number=out)[out >= 0]

    dealt = det.repartition(match, "island").sortWithinPartitions(match, "island", "frame_id", walk.descending("confidence"), "det_id")
    local = written(dealt.mapInPandas(run, schema), "tracks")
    born = local.groupBy(match, "island").agg(F.max("number").alias("born"))
    before = running_sums(born, [match], "island", {"born": "upto"}).select(F.col(match).alias("_match"), F.col("island").alias("_island"), (F.col("upto") - F.col("born")).alias("before"))
    out = local.join(before, (local[match] == before["_match"]) & (local["island"] == before["_island"]))
    return out.select(*[local[c] for c in det.columns if c != "island"], (F.col("number") + F.col("before")).alias("track_id"))


def validated_balls(
    det: DataFrame,
    match: str = "match_id",
    high: float = 0.5,
    low: float = 0.1,
    iou: float = 0.3,
    buffer: int = 30,
    cut: str | None = None,
    ball: int = 1,
    least: int = 5,
    limit: float = 0.15
) -> DataFrame:
    """Associated boxes with ``status``: of balls pending, valid or noise (see ball_verdicts), of others null.

    A ball's points count by the tracker's updates since the last scene cut. A track that comes back after more than
    eleven updates is judged anew; one that is cut off by a scene can't come back.
    """
    tracked = walked(det, islands(det, match, low, buffer, cut), match, high, low, iou, buffer)
    balls = tracked.filter(F.col("class_id") == ball)
    centre = {"_x": F.col("x") + F.col("w") / 2, "_y": F.col("y") + F.col("h") / 2}
    points = incarnations(balls.withColumns(centre), [match, "track_id"], "tick")
    points = points.select(match, "track_id", "incarnation", "tick", "frame_id", "det_id", F.col("_x").alias("x"), F.col("_y").alias("y"))
    judged = ball_verdicts(points, [match, "track_id", "incarnation"], "tick", least, limit).select(match, "frame_id", "det_id", "status")
    others = tracked.filter(F.coalesce(F.col("class_id") != ball, F.lit(True)))
    return balls.join(judged, [match, "frame_id", "det_id"]).select(*det.columns, "track_id", "status").unionByName(
        others.select(*det.columns, "track_id", F.lit(None).cast("string").alias("status"))
    )


class Trackers:
    """Trackers of many islands that take their next frames at once; the open tracks of all, by island and number.

    Each island's tracks are those of a Tracker of its own.
    """

    def __init__(self, high: float, low: float, iou: float, buffer: int):
        self.high, self.low, self.iou, self.buffer = high, low, iou, buffer
        self.lane, self.id, self.tick, self.cls = (np.zeros(0, np.int64) for _ in range(4))
        self.box, self.number = np.zeros((0, 4)), np.zeros(1, np.int64)

    def begin(self, lanes: int, new: bool) -> None:
        """Islands 0 to lanes - 1 come now; the first goes on where the last one was, unless it is new too."""
        keep = self.lane == (-1 if new else len(self.number) - 1)
        self._keep(keep)
        self.lane[:] = 0
        number = np.zeros(lanes, np.int64)
        number[0] = 0 if new else self.number[-1]
        self.number = number

    def _keep(self, keep: np.ndarray) -> None:
        self.lane, self.id, self.tick, self.cls, self.box = (v[keep] for v in (self.lane, self.id, self.tick, self.cls, self.box))

    def frames(self, lane: np.ndarray, box: np.ndarray, conf: np.ndarray, cls: np.ndarray, tick: np.ndarray) -> np.ndarray:
        """Numbers of the boxes of one frame for each of some islands, by island and falling confidence; -1 for boxes without one."""
        out, now = np.full(len(box), -1, np.int64), np.full(len(self.number), -(2**62))
        now[lane] = tick
        self._keep(now[self.lane] - self.buffer <= self.tick)
        taken = np.full(len(self.id), -1, np.int64)
        for stage in (conf >= self.high, (conf < self.high) & (conf >= self.low)):
            at = np.flatnonzero(stage)
            for i, j in zip(*self._near(at, lane, box, cls, taken), strict=True):
                if out[i] < 0 and taken[j] < 0:
                    out[i], taken[j] = self.id[j], i
        seen = np.flatnonzero(taken >= 0)
        by = taken[seen]
        self.box[seen], self.cls[seen], self.tick[seen] = box[by], cls[by], tick[by]
        born = np.flatnonzero((out < 0) & (conf >= self.high))
        if len(born):
            of = lane[born]
            first = np.searchsorted(of, of)
            out[born] = self.number[of] + np.arange(len(of)) - first + 1
            np.add.at(self.number, of, 1)
            order = np.argsort(np.concatenate([self.lane, of]), kind="stable")
            both = ((self.lane, of), (self.id, out[born]), (self.tick, tick[born]), (self.cls, cls[born]), (self.box, box[born]))
            self.lane, self.id, self.tick, self.cls, self.box = (np.concatenate(v)[order] for v in both)
        return out

    def _near(self, at: np.ndarray, lane: np.ndarray, box: np.ndarray, cls: np.ndarray, taken: np.ndarray) -> tuple[list[int], list[int]]:
        """Boxes and free tracks of one island and class that overlap enough, the best pairs first."""
        start = np.searchsorted(self.lane, lane[at])
        size = np.searchsorted(self.lane, lane[at], "right") - start
        i = np.repeat(at, size)
        j = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ok = (cls[i] == self.cls[j]) & (taken[j] < 0)
        i, j = i[ok], j[ok]
        inter = np.ones(len(i))
        for c in (0, 1):  # along x, then along y of what is left
            b, t, bw, tw = box[:, c], self.box[:, c], box[:, c + 2], self.box[:, c + 2]
            side = np.minimum((b + bw)[i], (t + tw)[j]) - np.maximum(b[i], t[j])
            meet = np.flatnonzero(side > 0) if self.iou > 0 else np.arange(len(i))
            i, j, inter = i[meet], j[meet], inter[meet] * np.clip(side[meet], 0, None)
        size_b, size_t = box[:, 2] * box[:, 3], self.box[:, 2] * self.box[:, 3]
        v = inter / np.maximum(size_b[i] + size_t[j] - inter, 1e-6)
        near = v >= self.iou
        i, j, v = i[near], j[near], v[near]
        order = np.lexsort((j, i, -v))
        return i[order].tolist(), j[order].tolist()


class Tracker:
    """Open tracks of one match: box, class and the frame that they were last seen in."""

    def __init__(self, high: float, low: float, iou: float, buffer: int):
        self.high, self.low, self.iou, self.buffer = high, low, iou, buffer
        self.open: dict[int, tuple[np.ndarray, int, int]] = {}
        self.number, self.tick = 0, 0

    def cut(self) -> None:
        """A new scene: open tracks end; numbers go on."""
        self.open = {}

    def frame(self, box: np.ndarray, conf: np.ndarray, cls: np.ndarray, tick: int | None = None) -> np.ndarray:
        """Track ids of the boxes of the next frame (or of update number ``tick``), by falling confidence; -1 for boxes without one."""
        out = np.full(len(box), -1, np.int64)
        self.tick = self.tick if tick is None else tick
        self.open = {k: v for k, v in self.open.items() if self.tick - v[2] <= self.buffer}
        free = set(self.open)
        for stage in (conf >= self.high, (conf < self.high) & (conf >= self.low)):
            at, ids = np.flatnonzero(stage), sorted(free)
            if not len(at) or not ids:
                continue
            t = np.array([self.open[k][0] for k in ids])
            lo = np.maximum(box[at][:, None, :2], t[None, :, :2])
            hi = np.minimum(box[at][:, None, :2] + box[at][:, None, 2:], t[None, :, :2] + t[None, :, 2:])
            inter = np.clip(hi - lo, 0, None).prod(-1)
            v = inter / np.maximum(box[at][:, None, 2:].prod(-1) + t[None, :, 2:].prod(-1) - inter, 1e-6)
            v[cls[at][:, None] != np.array([self.open[k][1] for k in ids])[None]] = 0
            for i, j in sorted(zip(*np.nonzero(v >= self.iou), strict=True), key=lambda ij: (-v[ij], ij)):
                if out[at[i]] < 0 and ids[j] in free:
                    out[at[i]] = ids[j]
                    free.discard(ids[j])
        for i in range(len(box)):
            if out[i] < 0 and conf[i] >= self.high:
                self.number += 1
                out[i] = self.number
            if out[i] >= 0:
                self.open[int(out[i])] = (box[i], cls[i], self.tick)
        self.tick += 1
        return out
