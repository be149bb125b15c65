"""Order-dependent clustering and de-duplication within small groups.

The groups are the objects of one frame, or one type of landmark in a frame; each rule needs a fixed order, given by a
column. Groups are dealt out by Spark; a group's walk is a small helper.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .walk import descending, labelled, labelled_alike


def _order(order: list[str], ascending: list[bool] | None) -> list:
    return [c if up else descending(c) for c, up in zip(order, ascending or [True] * len(order), strict=True)]


def suppress_overlaps(det: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Non-maximum suppression: by falling confidence, a box goes if a kept box overlaps it by an IoU over ``least``."""
    def label(x, y, w, h) -> list[int]:
        if len(x) == 1:
            return [0]
        if len(x) > 16:
            return many(x, y, w, h)
        kept, out = [], []
        for x1, y1, a, b in zip(x.tolist(), y.tolist(), w.tolist(), h.tolist(), strict=True):
            x2, y2, size = x1 + a, y1 + b, a * b
            over = False
            for u1, v1, u2, v2, other in kept:
                inter = max(0.0, min(x2, u2) - max(x1, u1)) * max(0.0, min(y2, v2) - max(y1, v1))
                if inter > least * max(size + other - inter, 1e-6):
                    over = True
                    break
            out.append(-1 if over else len(kept))
            if not over:
                kept.append((x1, y1, x2, y2, size))
        return out

    def many(x, y, w, h) -> list[int]:
        b = np.stack([x, y, w, h], 1).astype(float)
        lo, hi, size = b[:, :2], b[:, :2] + b[:, 2:], b[:, 2] * b[:, 3]
        kept, out = [], []
        for i in range(len(b)):
            if kept:
                inter = np.clip(np.minimum(hi[i], hi[kept]) - np.maximum(lo[i], lo[kept]), 0, None).prod(1)
                if (inter > least * np.maximum(size[i] + size[kept] - inter, 1e-6)).any():
                    out.append(-1)
                    continue
            out.append(len(kept))
            kept.append(i)
        return out

    return labelled(det, keys, [descending("confidence"), "det_id"], ["x", "y", "w", "h"], label).drop("cluster")


def leader_clusters(points: DataFrame, keys: list[str], order: list[str], radius: float, to: str = "seed", ascending: list[bool] | None = None) -> DataFrame:
    """points with ``cluster``: each joins the first cluster within the radius of its ``seed``, running ``mean`` or ``any`` member."""
    def means(x, y) -> np.ndarray:
        group, n = np.arange(len(x)), x.shape[1]
        sx, sy, count, found = np.zeros(x.shape), np.zeros(x.shape), np.zeros(x.shape, np.int64), np.zeros(len(x), np.int64)
        out = np.zeros(x.shape, np.int64)
        for p in range(n):
            mx, my = (s / np.maximum(count, 1) for s in (sx, sy))
            d = np.hypot(x[:, p, None] - mx, y[:, p, None] - my)
            near = d < radius
            for g, k in np.argwhere(np.abs(d - radius) <= 1e-9 * radius).tolist():  # too near to the radius for hypot
                near[g, k] = math.dist((x[g, p], y[g, p]), (mx[g, k], my[g, k])) < radius
            near &= count > 0
            c = np.where(near.any(1), near.argmax(1), found)
            found += c == found
            sx[group, c] += x[:, p]
            sy[group, c] += y[:, p]
            count[group, c] += 1
            out[:, p] = c
        return out

    if to == "mean":
        return labelled_alike(points, keys, _order(order, ascending), means)

    def label(x, y) -> list[int]:
        found: list[list[tuple[float, float]]] = []
        out = []
        for p in zip(x.tolist(), y.tolist(), strict=True):
            for k, c in enumerate(found):
                where = c[:1] if to == "seed" else c
                d = min(math.dist(p, q) for q in where)
                if d < radius or (to == "seed" and d == radius):
                    c.append(p)
                    out.append(k)
                    break
            else:
                found.append([p])
                out.append(len(found) - 1)
        return out

    return labelled(points, keys, _order(order, ascending), ["x", "y"], label)


def spaced(points: DataFrame, keys: list[str], order: list[str], gap: float, ascending: list[bool] | None = None) -> DataFrame:
    """Points kept in order, each at least ``gap`` from those kept before."""
    def label(x, y) -> list[int]:
        kept: list[tuple[float, float]] = []
        out = []
        for p in zip(x.tolist(), y.tolist(), strict=True):
            near = any(math.dist(p, q) < gap for q in kept)
            out.append(-1 if near else len(kept))
            if not near:
                kept.append(p)
        return out

    return labelled(points, keys, _order(order, ascending), ["x", "y"], label).drop("cluster")


def linked(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Numbers of the connected components of points within eps, for groups of one size (rows), in the order of their first points."""
    def walked(x, y) -> np.ndarray:
        p = np.stack([x, y], 1)
        out, n = np.full(len(p), -1), 0
        for i in range(len(p)):
            if out[i] < 0:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if out[j] < 0:
                        out[j] = n
                        todo += np.flatnonzero((out < 0) & (np.hypot(*(p - p[j]).T) <= eps)).tolist()
                n += 1
        return out

    n = x.shape[1]
    if n > 64:
        return np.stack([walked(*g) for g in zip(x, y, strict=True)])
    near = (np.hypot(x[:, :, None] - x[:, None], y[:, :, None] - y[:, None]) <= eps) | np.eye(n, dtype=bool)
    root = np.broadcast_to(np.arange(n), x.shape)
    while True:  # each row takes the first row that its neighbours know of
        then = np.where(near, root[:, None], n).min(2)
        if (then == root).all():
            break
        root = then
    return np.take_along_axis(np.cumsum(root == np.arange(n), 1) - 1, root, 1)


def linked_clusters(points: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """points with ``cluster``: connected components of points within eps (density clustering whose least size is one)."""
    return labelled_alike(points, keys, ["x", "y"], lambda x, y: linked(x, y, eps))


def grid_fuse(points: DataFrame, keys: list[str], cell: float = 8.0) -> DataFrame:
    """One point for each grid cell: medians and the number of points; cells round half to even."""
    at = lambda c: (F.bround(F.col(c) / cell) * cell)
    g = points.withColumns({"cell_x": at("x"), "cell_y": at("y")}).groupBy(*keys, "cell_x", "cell_y")
    return g.agg(F.median("x").alias("x"), F.median("y").alias("y"), F.count(F.lit(1)).alias("n"))


def line_pairs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Intersections of the lines (a, b, c) of a group, i before j, that aren't parallel."""
    l, r = lines.alias("l"), lines.alias("r")
    on = F.col("l.line_id") < F.col("r.line_id")
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    x, y = G.line_intersection(*[tuple(F.col(f"{s}.{c}") for c in "abc") for s in "lr"])
    return l.join(r, on).select(
        *[F.col(f"l.{k}") for k in keys],
        F.col("l.line_id").alias("i"),
        F.col("r.line_id").alias("j"),
        x.alias("x"),
        y.alias("y")
    ).filter("x IS NOT NULL")
