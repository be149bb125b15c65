"""The line stage's steps on a batch of whole frames, whose lines stand by their numbers; frames of one size are taken at once.

``at`` has the frames' first rows and the end. Lines are a, b, c with a unit normal.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np

from .cluster import linked
from .walk import alike


def crossings(l: tuple, r: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y of where lines meet, and whether they do (aren't nearly parallel)."""
    (a1, b1, c1), (a2, b2, c2) = l, r
    det = a1 * b2 - a2 * b1
    with np.errstate(all="ignore"):
        return (b1 * c2 - b2 * c1) / det, (a2 * c1 - a1 * c2) / det, ~(np.abs(det) < 1e-10)


def _hashed_pairs(ids: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, trials: int) -> tuple[np.ndarray, np.ndarray]:
    """The crossing pairs of one frame's lines whose numbers have the least digests, without holding all pairs."""
    def digests() -> Iterator[tuple[bytes, int, int]]:
        names = [str(int(v)).encode() if v == v else b"" for v in ids.tolist()]
        for i in range(len(ids) - 1):
            ok = crossings((a[i], b[i], c[i]), (a[i + 1 :], b[i + 1 :], c[i + 1 :]))[2] & (ids[i] < ids[i + 1 :])
            for j in (np.flatnonzero(ok) + i + 1).tolist():
                yield hashlib.md5(names[i] + b"-" + names[j]).digest(), i, j

    pairs = sorted((i, j) for _, i, j in heapq.nsmallest(trials, digests()))
    return np.array([i for i, _ in pairs], np.int64), np.array([j for _, j in pairs], np.int64)


def _voted(ids: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """votes, vx, vy for frames of one size (rows): the first of the crossings of lines i and j that most lines are near, moved to its voters."""
    hx, hy, ok = crossings((a[:, i], b[:, i], c[:, i]), (a[:, j], b[:, j], c[:, j]))
    with np.errstate(all="ignore"):
        close = np.abs(a[:, None] * hx[:, :, None] + b[:, None] * hy[:, :, None] + c[:, None]) < near
    votes = np.where(ok & (ids[:, i] < ids[:, j]), close.sum(2), 0)
    k = votes.argmax(1)[:, None]
    votes, hx, hy, voter = *(np.take_along_axis(v, k, 1)[:, 0] for v in (votes, hx, hy)), np.take_along_axis(close, k[:, :, None], 1)[:, 0]
    aa, ab, bb, ac, bc = (np.where(voter, p * q, 0.0).sum(1) for p, q in ((a, a), (a, b), (b, b), (a, c), (b, c)))
    det = aa * bb - ab * ab
    with np.errstate(all="ignore"):
        return votes, np.where(det > 1e-9, (ab * bc - bb * ac) / det, hx), np.where(det > 1e-9, (ab * ac - aa * bc) / det, hy)


def points(ids: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, at: np.ndarray, trials: int, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """votes, vx, vy of each frame's vanishing point; 0 votes where there is none."""
    frames = len(at) - 1
    votes, vx, vy = np.zeros(frames, np.int64), np.full(frames, np.nan), np.full(frames, np.nan)
    for g, rows in alike(at, lambda n: min(n * n, 2 * trials) * n // 2):
        n = rows.shape[1]
        if n * (n - 1) // 2 > trials:
            for f, r in zip(g.tolist(), rows, strict=True):
                i, j = _hashed_pairs(ids[r], a[r], b[r], c[r], trials)
                if len(i):
                    (votes[f],), (vx[f],), (vy[f],) = _voted(ids[None, r], a[None, r], b[None, r], c[None, r], i, j, near)
        elif n > 1:
            votes[g], vx[g], vy[g] = _voted(ids[rows], a[rows], b[rows], c[rows], *np.triu_indices(n, 1), near)
    return votes, vx, vy


def merged(ids, a, b, c, x, y, at: np.ndarray, found: tuple, near: float, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """frame, longitudinal, line, [a, b, c] of the lines merged from those of frames with a point, longitudinal ones of a frame first."""
    votes, vx, vy = found
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    with np.errstate(all="ignore"):
        along = np.abs(a * vx[of] + b * vy[of] + c) < near
    rows = np.lexsort((~along, of))
    rows = rows[votes[of[rows]] > 0]
    group, cluster = 2 * of[rows] + ~along[rows], np.zeros(len(rows), np.int64)
    ends = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(rows))
    for _, r in alike(ends, lambda n: n * n):
        if r.shape[1] > 1:
            cluster[r] = linked(x[rows[r]], y[rows[r]], eps)
    by = np.lexsort((cluster, group))
    rows, group, cluster = rows[by], group[by], cluster[by]
    first = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(cluster, prepend=-1) != 0))
    if not len(first):
        return of[:0], along[:0], ids[:0], [a[:0]] * 3
    count = np.diff(np.append(first, len(rows)))
    mean = [np.add.reduceat(v[rows], first) / count for v in (a, b, c)]
    size = np.sqrt(mean[0] * mean[0] + mean[1] * mean[1])
    kept, first = ~(size < 1e-10), rows[first]
    return of[first][kept], along[first][kept], ids[first][kept], [v[kept] / size[kept] for v in mean]


def spaced(x: np.ndarray, y: np.ndarray, gap: float) -> np.ndarray:
    """Which points of groups of one size (rows) stay if each that is nearer than ``gap`` to one kept before goes."""
    groups, n = x.shape
    stays = np.ones(x.shape, bool)
    if n > 64:
        for k in range(groups):
            kx, ky, kept = np.empty(n), np.empty(n), 0
            for p in range(n):
                dx, dy = x[k, p] - kx[:kept], y[k, p] - ky[:kept]
                if (np.sqrt(dx * dx + dy * dy) < gap).any():
                    stays[k, p] = False
                else:
                    kx[kept], ky[kept], kept = x[k, p], y[k, p], kept + 1
        return stays
    dx, dy = x[:, :, None] - x[:, None], y[:, :, None] - y[:, None]
    near = np.sqrt(dx * dx + dy * dy) < gap
    for p in range(1, n):
        stays[:, p] = ~(near[:, p, :p] & stays[:, :p]).any(1)
    return stays


def keypoints(of: np.ndarray, along: np.ndarray, line: np.ndarray, abc: list[np.ndarray], bounds: tuple, gap: float, most: int = 4_000_000) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """frame and i, j, x, y of where merged longitudinal lines meet transversal ones within bounds, spaced."""
    l, t = np.flatnonzero(along), np.flatnonzero(~along)
    start, many = np.searchsorted(of[t], of[l]), np.searchsorted(of[t], of[l], "right")
    many -= start
    cuts = np.flatnonzero(np.diff(np.cumsum(many) // most, prepend=0))
    found = []
    for s, n, r in zip(np.split(start, cuts), np.split(many, cuts), np.split(l, cuts), strict=True):
        i = np.repeat(r, n)
        j = t[np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())]
        x, y, ok = crossings([v[i] for v in abc], [v[j] for v in abc])
        x1, x2, y1, y2 = bounds
        ok &= (x >= x1) & (x <= x2) & (y >= y1) & (y <= y2)
        found.append((i[ok], j[ok], x[ok], y[ok]))
    i, j, x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    stays = np.ones(len(i), bool)
    for _, rows in alike(np.append(np.flatnonzero(np.diff(of[i], prepend=-1)), len(i)), lambda n: n * n):
        stays[rows] = spaced(x[rows], y[rows], gap)
    i, j = i[stays], j[stays]
    return of[i], {"i": line[i], "j": line[j], "x": x[stays], "y": y[stays]}
