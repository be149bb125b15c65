"""Stateful operators that take the rows of a key in order, whatever order files bring them in.

Rows wait in the state until the watermark passes them; then a timer hands the frames that are due, in order, to the
operator. A frame that comes twice counts once, and rows behind the watermark are dropped by Spark, so the result is
that of one walk over the key's frames as long as nothing is later than the watermark allows. The state holds the
frames between the watermark and the newest one, and what the operator keeps.

The streams need the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geometry import PITCH_LENGTH, PITCH_WIDTH
from ..operators.calibration import homography_of
from ..operators.tracks import Tracker


class InOrder(StatefulProcessor):
    """Rows of a key by ``order``, each number of it as one frame; rows of a frame are told apart by ``unique``.

    columns: name and type of what is kept of a row. Subclasses take frames in ``frame`` and load and store their state
    around the frames that are due.
    """

    def __init__(self, key: str, order: str, unique: str, columns: dict[str, str], out: list[str]):
        self.key, self.order, self.unique, self.columns, self.out = key, order, unique, columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(f"{c} array<{t}>" for c, t in self.columns.items())
        self.held = handle.getMapState("held", "at long", f"due long, {fields}")
        self.reached = handle.getValueState("reached", "at long")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        """Open the operator's own state."""

    def load(self) -> None:
        """Read the operator's state before frames."""

    def frame(self, key, at: int, rows: dict[str, list]) -> list[tuple]:
        """Output rows of the next frame, without the key."""
        raise TypeError("a subclass takes the frames")

    def store(self) -> None:
        """Write the operator's state after frames."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.reached.get()[0] if self.reached.exists() else None
        for pdf in rows:
            for at, part in pdf.groupby(self.order):
                at = int(at)
                if last is not None and at <= last:  # came again
                    continue
                due = int(part["time"].max().timestamp() * 1000)
                kept = {c: [] for c in self.columns}
                if self.held.containsKey((at,)):
                    old = self.held.getValue((at,))
                    due = max(due, old[0])
                    kept = {c: list(v) for c, v in zip(self.columns, old[1:], strict=True)}
                seen = set(kept[self.unique])
                for values in zip(*[part[c].tolist() for c in self.columns], strict=True):
                    row = dict(zip(self.columns, values, strict=True))
                    if row[self.unique] not in seen:
                        seen.add(row[self.unique])
                        for c, v in row.items():
                            kept[c].append(v)
                self.held.updateValue((at,), (due, *kept.values()))
                self.handle.registerTimer(due)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        due = sorted((k[0], v) for k, v in list(self.held.iterator()) if v[0] <= mark)
        out: list[tuple] = []
        if due:
            self.load()
            for at, values in due:
                rows = {c: list(v) for c, v in zip(self.columns, values[1:], strict=True)}
                out += [(*key, *r) for r in self.frame(key, at, rows)]
                self.held.removeKey((at,))
            self.store()
            self.reached.update((due[-1][0],))
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def applied(stream: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    """The processor's rows over a stream with a watermark on ``time``."""
    return stream.groupBy(processor.key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def trajectory_score(t: list[float], x: list[float], y: list[float]) -> float:
    """0.7 of the mean distance of y to its best parabola and 0.3 of that of x to its best line, each over its range."""
    t_, score = np.array(t, float) - t[0], 0.0
    for v, degree, weight in ((np.array(y, float), 2, 0.7), (np.array(x, float), 1, 0.3)):
        basis = t_[:, None] ** np.arange(degree + 1)
        fit = basis @ np.linalg.lstsq(basis, v, rcond=None)[0]
        score += weight * np.abs(v - fit).mean() / (np.ptp(v) + 1e-6)
    return score


class Verdicts:
    """Points of open tracks up to the verdict: (last update, points, their t, x and y, status)."""

    def __init__(self, least: int, limit: float, gap: int):
        self.least, self.limit, self.gap = least, limit, gap
        self.open: dict[int, tuple[int, int, list[float], list[float], list[float], str]] = {}

    def add(self, track: int, tick: int, x: float, y: float) -> tuple[int, str]:
        """How many points the track has now, and its status."""
        last, n, ts, xs, ys, status = self.open.get(track) or (tick, 0, [], [], [], "pending")
        if tick - last > self.gap:
            n, ts, xs, ys, status = 0, [], [], [], "pending"
        n += 1
        if n <= self.least:
            ts, xs, ys = [*ts, float(tick)], [*xs, float(x)], [*ys, float(y)]
        if n == self.least:
            status, ts, xs, ys = "valid" if trajectory_score(ts, xs, ys) < self.limit else "noise", [], [], []
        self.open[track] = (tick, n, ts, xs, ys, status)
        return n, status

    def prune(self, tick: int) -> None:
        """Forget tracks that would begin anew."""
        self.open = {k: v for k, v in self.open.items() if tick - v[0] < self.gap}


def _stored(state, now: dict, before: dict) -> None:
    """Bring a map state from ``before`` to ``now``."""
    for k in before.keys() - now.keys():
        state.removeKey((k,))
    for k, v in now.items():
        if before.get(k) != v:
            state.updateValue((k,), v)


class Association(InOrder):
    """Two-stage association and the verdicts on ball tracks; open tracks of a match as its state."""

    def __init__(self, high: float, low: float, iou: float, buffer: int, ball: int, least: int, limit: float):
        kinds = {"det_id": "long", "class_id": "int", "confidence": "double", "x": "double", "y": "double", "w": "double", "h": "double", "cut": "boolean"}
        super().__init__("match_id", "frame_id", "det_id", kinds, ["match_id", "frame_id", "det_id", "class_id", "track_id", "status"])
        self.rules, self.ball, self.verdict = (high, low, iou, buffer), ball, (least, limit, 11)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getMapState("tracks", "track long", "x double, y double, w double, h double, class_id int, tick long")
        points = "last long, n long, t array<double>, x array<double>, y array<double>, status string"
        self.balls = handle.getMapState("balls", "track long", points)
        self.counts = handle.getValueState("counts", "number long, tick long")

    def load(self) -> None:
        self.tracker, self.judge = Tracker(*self.rules), Verdicts(*self.verdict)
        if self.counts.exists():
            self.tracker.number, self.tracker.tick = self.counts.get()
        self.was = {k[0]: tuple(v) for k, v in list(self.tracks.iterator())}
        self.tracker.open = {k: (np.array(v[:4]), v[4], v[5]) for k, v in self.was.items()}
        self.were = {k[0]: (v[0], v[1], list(v[2]), list(v[3]), list(v[4]), v[5]) for k, v in list(self.balls.iterator())}
        self.judge.open = dict(self.were)

    def frame(self, key, at: int, rows: dict[str, list]) -> list[tuple]:
        if any(c is True for c in rows["cut"]):
            self.tracker.cut()
            self.judge.open = {}
        conf = [np.nan if c is None else c for c in rows["confidence"]]
        order = sorted(range(len(conf)), key=lambda i: (conf[i] != conf[i], -conf[i] if conf[i] == conf[i] else 0, rows["det_id"][i]))
        box = np.array([[rows[c][i] for c in ("x", "y", "w", "h")] for i in order], float)
        kind = [rows["class_id"][i] for i in order]
        tick = self.tracker.tick
        ids = self.tracker.frame(box, np.array([conf[i] for i in order], float), np.array(kind))
        out = []
        for i, k, track, b in zip(order, kind, ids.tolist(), box.tolist(), strict=True):
            if track >= 0:
                status = self.judge.add(track, tick, b[0] + b[2] / 2, b[1] + b[3] / 2)[1] if k == self.ball else None
                out.append((at, rows["det_id"][i], k, track, status))
        self.judge.prune(tick)
        return out

    def store(self) -> None:
        alive = {k: (*map(float, v[0]), int(v[1]), int(v[2])) for k, v in self.tracker.open.items() if self.tracker.tick - v[2] <= self.tracker.buffer}
        _stored(self.tracks, alive, self.was)
        _stored(self.balls, self.judge.open, self.were)
        self.counts.update((self.tracker.number, self.tracker.tick))


def associated(
    detections: DataFrame,
    high: float = 0.5,
    low: float = 0.1,
    iou: float = 0.3,
    buffer: int = 30,
    ball: int = 1,
    least: int = 5,
    limit: float = 0.15
) -> DataFrame:
    """A stream of boxes (with ``time`` and a watermark, and cut: a scene begins) -> match_id, frame_id, det_id, class_id, track_id, status.

    Equal to operators.tracks.validated_balls over the same boxes.
    """
    processor = Association(high, low, iou, buffer, ball, least, limit)
    return applied(detections, processor, "match_id long, frame_id long, det_id long, class_id int, track_id long, status string")


class TrackStatus(InOrder):
    """Verdicts on given tracks; the points up to the verdict are the state of each track."""

    def __init__(self, least: int, limit: float, gap: int):
        super().__init__("track_id", "n", "n", {"n": "long", "x": "double", "y": "double"}, ["track_id", "n", "incarnation", "points", "status"])
        self.verdict = (least, limit, gap)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.track = handle.getValueState("track", "born int, last long, n long, t array<double>, x array<double>, y array<double>, status string")

    def load(self) -> None:
        self.judge, self.born = Verdicts(*self.verdict), 0
        if self.track.exists():
            self.born, last, n, ts, xs, ys, status = self.track.get()
            self.judge.open[0] = (last, n, list(ts), list(xs), list(ys), status)

    def frame(self, key, at: int, rows: dict[str, list]) -> list[tuple]:
        seen = 0 in self.judge.open
        n, status = self.judge.add(0, at, rows["x"][0], rows["y"][0])
        self.born += seen and n == 1
        return [(at, self.born, n, status)]

    def store(self) -> None:
        self.track.update((self.born, *self.judge.open[0]))


def track_status(points: DataFrame, least: int = 5, limit: float = 0.15, gap: int = 11) -> DataFrame:
    """A stream of points(track_id, n, x, y, time) -> track_id, n, incarnation, points, status; equal to tracks.ball_verdicts for each incarnation."""
    return applied(points, TrackStatus(least, limit, gap), "track_id long, n long, incarnation int, points int, status string")


class Checkpoints(InOrder):
    """Counts a match's frames with events; the events since the last checkpoint wait for the next."""

    def __init__(self, every: int):
        super().__init__("match_id", "end_frame", "event", {"event": "string"}, ["match_id", "checkpoint", "end_frame", "event"])
        self.every = every

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.waiting = handle.getListState("waiting", "at long, event string")

    def load(self) -> None:
        self.n = self.count.get()[0] if self.count.exists() else 0
        self.rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def frame(self, key, at: int, rows: dict[str, list]) -> list[tuple]:
        self.n += 1
        self.rows += [(at, e) for e in sorted(rows["event"])]
        if self.n % self.every:
            return []
        out, self.rows = [(self.n, *r) for r in self.rows], []
        return out

    def store(self) -> None:
        self.count.update((self.n,))
        if self.rows:
            self.waiting.put(self.rows)
        else:
            self.waiting.clear()


def event_checkpoints(events: DataFrame, every: int = 300) -> DataFrame:
    """A stream of events(match_id, end_frame, event: its JSON, time) -> match_id, checkpoint, end_frame, event.

    checkpoint is the number of frames with events at which the event is saved first, a multiple of ``every``; a
    checkpoint's rows come all in one batch, once its last frame is known. What was saved before counts too: the events
    up to a checkpoint are those with its number or a smaller one.
    """
    return applied(events, Checkpoints(every), "match_id long, checkpoint long, end_frame long, event string")


def write_checkpoints(checkpoints: DataFrame, folder: str, checkpoint: str):
    """A folder for each match and checkpoint, each written once, also if the stream is stopped and started again."""
    out = checkpoints.writeStream.format("json").partitionBy("match_id", "checkpoint").option("path", folder)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _average(points: list[tuple], images: int, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """x, y, px, py of the averaged landmarks among (type, x, y, px, py), as operators.landmarks.averaged gives them."""
    clusters: dict[str, list[list[tuple]]] = {}
    for kind, *p in points:
        near = next((c for c in clusters.setdefault(kind, []) if np.hypot(c[0][0] - p[0], c[0][1] - p[1]) <= 50.0), None)
        if near is None:
            clusters[kind].append([tuple(p)])
        else:
            near.append(tuple(p))
    out = []
    for kind, found in clusters.items():
        for c in found:
            a = np.array(c, float)
            q1, q3 = np.percentile(a[:, :2], [25, 75], axis=0)
            inside = ((a[:, :2] >= q1 - 1.5 * (q3 - q1)) & (a[:, :2] <= q3 + 1.5 * (q3 - q1))).all(axis=1)
            if len(a) >= 3 and inside.sum() >= len(a) * 0.5:
                a = a[inside]
            x, y, px, py = np.median(a, axis=0)
            if len(a) == 1 or _plausible(kind, x, y, px, py, w, h):
                out.append((x, y, px, py))
    return out


def _plausible(kind: str, x: float, y: float, px: float, py: float, w: float, h: float, length: float = 105.0) -> bool:
    """The bounds of operators.landmarks.plausible_average."""
    fits = {
        "goal": (x < w * 0.35 or x > w * 0.65) and abs(abs(px) - length / 2) <= 15,
        "corner": (x < w * 0.4 or x > w * 0.6) and (y < h * 0.4 or y > h * 0.6),
        "center_circle": np.hypot(x - w / 2, y - h / 2) <= min(w, h) * 0.5 and np.hypot(px, py) <= 15,
        "center_line": abs(y - h / 2) <= h * 0.4 and abs(py) <= 5,
    }
    return 0 <= x <= w and 0 <= y <= h and fits.get(kind, True)


class FrozenModel(InOrder):
    """The homography of a match's first frames, fitted once; landmarks wait in the state until then."""

    def __init__(self, frames: int, w: float, h: float):
        kinds = {"det_id": "long", "x": "double", "y": "double", "type": "string", "px": "double", "py": "double"}
        super().__init__("match_id", "frame_id", "det_id", kinds, ["match_id", "frame_id", "det_id", "px", "py", "model"])
        self.frames, self.w, self.h = frames, w, h

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "frames long, homography array<double>")
        self.points = handle.getListState("points", "type string, x double, y double, px double, py double")

    def load(self) -> None:
        self.seen, self.homography = self.model.get() if self.model.exists() else (0, None)
        self.landmarks = [tuple(p) for p in self.points.get()] if self.points.exists() else []

    def frame(self, key, at: int, rows: dict[str, list]) -> list[tuple]:
        order = sorted(range(len(rows["det_id"])), key=lambda i: rows["det_id"][i])
        if self.seen < self.frames:
            self.seen += 1
            self.landmarks += [tuple(rows[c][i] for c in ("type", "x", "y", "px", "py")) for i in order if rows["type"][i] is not None]
            if self.seen == self.frames:
                points = _average(self.landmarks, self.frames, self.w, self.h)
                self.homography = homography_of(*np.array(points, float).reshape(-1, 4).T)
                self.landmarks = []
        out = []
        for i in order:
            x, y = rows["x"][i], rows["y"][i]
            if self.homography is None:
                px, py = x / self.w * PITCH_LENGTH - PITCH_LENGTH / 2, y / self.h * PITCH_WIDTH - PITCH_WIDTH / 2
            else:
                u, v, k = np.array(self.homography).reshape(3, 3) @ (x, y, 1.0)
                px, py = u / (k if abs(k) >= 1e-10 else 1e-10), v / (k if abs(k) >= 1e-10 else 1e-10)
            out.append((at, rows["det_id"][i], float(px), float(py), "fallback" if self.homography is None else "frozen"))
        return out

    def store(self) -> None:
        self.model.update((self.seen, self.homography))
        if self.landmarks:
            self.points.put(self.landmarks)
        else:
            self.points.clear()


def frozen_positions(points: DataFrame, frames: int = 10, w: float = 1920.0, h: float = 1080.0) -> DataFrame:
    """A stream of points(match_id, frame_id, det_id, x, y, and of landmarks type, px, py) -> their places on the pitch and ``model``.

    Until a match's first ``frames`` frames are known, points are mapped by the image's size (model ``fallback``); from
    the last of these on, by the homography that their landmarks give (``frozen``), for good. Equal to
    operators.calibration.calibrated without its second pass.
    """
    return applied(points, FrozenModel(frames, w, h), "match_id long, frame_id long, det_id long, px double, py double, model string")
