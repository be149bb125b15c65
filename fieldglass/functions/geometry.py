"""Geometry of boxes, points, lines and pitch coordinates as Column functions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str
PITCH_LENGTH, PITCH_WIDTH = 105.0, 68.0


def _c(x: C | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def center(x: C, y: C, w: C, h: C) -> tuple[Column, Column]:
    return _c(x) + _c(w) / 2, _c(y) + _c(h) / 2


def feet(x1: C, x2: C, y2: C) -> tuple[Column, Column]:
    """Bottom centre of a corner box."""
    return (_c(x1) + _c(x2)) / 2, _c(y2)


def to_corners(x: C, y: C, w: C, h: C) -> tuple[Column, Column, Column, Column]:
    return _c(x), _c(y), _c(x) + _c(w), _c(y) + _c(h)


def to_sizes(x1: C, y1: C, x2: C, y2: C, clamp: bool = False) -> tuple[Column, Column, Column, Column]:
    """Corner box to x, y, w, h; with clamp, sizes aren't negative."""
    w, h = _c(x2) - _c(x1), _c(y2) - _c(y1)
    return (_c(x1), _c(y1), F.greatest(F.lit(0.0), w), F.greatest(F.lit(0.0), h)) if clamp else (_c(x1), _c(y1), w, h)


def to_center_box(x1: C, y1: C, x2: C, y2: C) -> tuple[Column, Column, Column, Column]:
    return (_c(x1) + _c(x2)) / 2, (_c(y1) + _c(y2)) / 2, _c(x2) - _c(x1), _c(y2) - _c(y1)


def denormalize(cx: C, cy: C, w: C, h: C, width: C | float, height: C | float) -> tuple[Column, Column, Column, Column]:
    """Centre box in shares of the image to x, y, w, h in pixels."""
    pw, ph = _c(w) * _c(width), _c(h) * _c(height)
    return _c(cx) * _c(width) - pw / 2, _c(cy) * _c(height) - ph / 2, pw, ph


def percent_of(value: C, whole: C | float) -> Column:
    return _c(value) / _c(whole) * 100


def clip_box(x: C, y: C, w: C, h: C, width: float, height: float) -> tuple[Column, Column, Column, Column]:
    """Box cut at the image's edges as corners; empty ones have x2 <= x1 or y2 <= y1."""
    top = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))
    x1, y1, x2, y2 = to_corners(x, y, w, h)
    return top(x1, width), top(y1, height), top(x2, width), top(y2, height)


def area(w: C, h: C) -> Column:
    return _c(w) * _c(h)


def pixel_to_pitch(x: C, y: C, width: float = 1920.0, height: float = 1080.0, y_scale: C | float = 1.0) -> tuple[Column, Column]:
    """Linear fallback when no homography is known: origin at the pitch's centre."""
    return _c(x) / width * PITCH_LENGTH - PITCH_LENGTH / 2, (_c(y) / height * PITCH_WIDTH - PITCH_WIDTH / 2) * _c(y_scale)


def homography(h: list[float] | Column, x: C, y: C, y_scale: C | float = 1.0, guard: float = 1e-10) -> tuple[Column, Column]:
    """Point through a 3 x 3 matrix (row by row); a weight near 0 counts as ``guard``."""
    m = [F.get(h, F.lit(i)) for i in range(9)] if isinstance(h, Column) else [F.lit(float(v)) for v in h]
    x, y = _c(x), _c(y)
    w = m[6] * x + m[7] * y + m[8]
    w = F.when(F.abs(w) < guard, F.lit(guard)).otherwise(w)
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w * _c(y_scale)


def transform_box(h: list[float] | Column, x1: C, y1: C, x2: C, y2: C) -> tuple[Column, Column, Column, Column]:
    """Bounding box of the four corners' images."""
    points = [homography(h, a, b) for a in (x1, x2) for b in (y1, y2)]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def distance(x1: C, y1: C, x2: C, y2: C) -> Column:
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def distance_to_center(x: C, y: C) -> Column:
    """From pitch coordinates, whose scale the mapping has applied already."""
    return F.sqrt(_c(x) * _c(x) + _c(y) * _c(y))


def velocity(dist: C, dt: C) -> Column:
    return F.when(_c(dt) <= 0, F.lit(0.0)).otherwise(_c(dist) / _c(dt))


def pitch_to_map(x: C, y: C, map_w: float, map_h: float) -> tuple[Column, Column]:
    return (_c(x) + PITCH_LENGTH / 2) / PITCH_LENGTH * map_w, (_c(y) + PITCH_WIDTH / 2) / PITCH_WIDTH * map_h


def normalized_to_pitch(nx: C, ny: C) -> tuple[Column, Column]:
    return (_c(nx) - 0.5) * PITCH_LENGTH, (_c(ny) - 0.5) * PITCH_WIDTH


def overlap(a: tuple, b: tuple) -> Column:
    """Area that two corner boxes share."""
    w = F.least(_c(a[2]), _c(b[2])) - F.greatest(_c(a[0]), _c(b[0]))
    h = F.least(_c(a[3]), _c(b[3])) - F.greatest(_c(a[1]), _c(b[1]))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: tuple, b: tuple, floor: float | None = 1e-6) -> Column:
    """Intersection over union of corner boxes. With floor, the union is at least that; without, 0 where it is empty."""
    both = overlap(a, b)
    size = lambda r: (_c(r[2]) - _c(r[0])) * (_c(r[3]) - _c(r[1]))
    union = size(a) + size(b) - both
    return both / F.greatest(union, F.lit(floor)) if floor is not None else F.when(union <= 0, F.lit(0.0)).otherwise(both / union)


def segment_polar(x1: C, y1: C, x2: C, y2: C) -> tuple[Column, Column]:
    """(rho, theta) of a segment's line, theta from 0; a segment without length is (0, 0)."""
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    flat = (dx == 0) & (dy == 0)
    size = F.sqrt(dx * dx + dy * dy)
    theta = F.atan2(dx, -dy)
    rho = (_c(x1) * -dy + _c(y1) * dx) / size
    theta = F.when(theta < 0, theta + F.pi()).otherwise(theta)
    return F.when(flat, F.lit(0.0)).otherwise(rho), F.when(flat, F.lit(0.0)).otherwise(theta)


def segment_line(x1: C, y1: C, x2: C, y2: C) -> tuple[Column, Column, Column]:
    """a, b, c of the line ax + by + c = 0 with a unit normal; null for a segment without length."""
    a, b = _c(y2) - _c(y1), _c(x1) - _c(x2)
    n = F.sqrt(a * a + b * b)
    n = F.when(n > 0, n)
    return a / n, b / n, -(a * _c(x1) + b * _c(y1)) / n


def line_intersection(l1: tuple, l2: tuple, least: float = 1e-10) -> tuple[Column, Column]:
    """Point of two lines (a, b, c); null if they are nearly parallel."""
    (a1, b1, c1), (a2, b2, c2) = (tuple(map(_c, x)) for x in (l1, l2))
    det = a1 * b2 - a2 * b1
    ok = F.abs(det) >= least
    return F.when(ok, (b1 * c2 - b2 * c1) / det), F.when(ok, (a2 * c1 - a1 * c2) / det)


def segment_intersection(p: tuple, q: tuple) -> tuple[Column, Column]:
    """Point of two segments (x1, y1, x2, y2); null if they don't meet."""
    (x1, y1, x2, y2), (x3, y3, x4, y4) = (tuple(map(_c, s)) for s in (p, q))
    den = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    t = ((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4)) / F.when(F.abs(den) >= 1e-10, den)
    u = -((x1 - x2) * (y1 - y3) - (y1 - y2) * (x1 - x3)) / F.when(F.abs(den) >= 1e-10, den)
    ok = t.between(0, 1) & u.between(0, 1)
    return F.when(ok, x1 + t * (x2 - x1)), F.when(ok, y1 + t * (y2 - y1))


def point_line_distance(line: tuple, x: C, y: C) -> Column:
    a, b, c = map(_c, line)
    return F.abs(a * _c(x) + b * _c(y) + c)


def quad_area(points: list[tuple[C, C]]) -> Column:
    """Area of a polygon by the shoelace sum."""
    total = F.lit(0.0)
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]], strict=True):
        total = total + _c(x1) * _c(y2) - _c(x2) * _c(y1)
    return F.abs(total) / 2


def mirror(value: C, middle: C | float) -> Column:
    return 2 * _c(middle) - _c(value)


def ratio(a: C, b: C) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(_c(b) > 0, _c(a) / _c(b)).otherwise(F.lit(0.0))


def f1(precision: C, recall: C) -> Column:
    p, r = _c(precision), _c(recall)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def tiles(width: C | float, height: C | float, size: int = 640, overlap_share: float = 0.2) -> Column:
    """Array of the upper left corners of overlapping tiles that cover an image; the last row and column touch its edge."""
    step = int(size * (1 - overlap_share))

    def starts(side: C | float) -> Column:
        last = F.greatest(F.lit(0), (_c(side) - size).cast("int"))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.ceil(last / step).cast("int")), lambda i: F.least(i * step, last)))

    xs, ys = starts(width), starts(height)
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def corner_tiles(width: C | float, height: C | float, size: int = 640) -> Column:
    """The centre tile and, for images over 1.5 tiles wide and high, the four corner tiles, without repeats."""
    w, h = _c(width).cast("int"), _c(height).cast("int")
    right, low = F.greatest(F.lit(0), w - size), F.greatest(F.lit(0), h - size)
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    middle = lambda side: F.greatest(F.lit(0), F.floor(side / 2) - size // 2)
    zero = F.lit(0)
    centre = F.array(at(middle(w), middle(h)))
    corners = F.array(at(zero, zero), at(right, zero), at(zero, low), at(right, low))
    return F.when((w > 1.5 * size) & (h > 1.5 * size), F.array_distinct(F.concat(centre, corners))).otherwise(centre)


def circle_points(cx: C, cy: C, r: C, n: int = 12) -> Column:
    """n points of a circle, from angle 0 on."""
    angle = lambda i: i * (2 * F.pi() / n)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct((_c(cx) + _c(r) * F.cos(angle(i))).alias("x"), (_c(cy) + _c(r) * F.sin(angle(i))).alias("y"))
    )


def line_points(x1: C, y1: C, x2: C, y2: C, n: int = 12) -> Column:
    """n evenly spaced points of a segment, ends included."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct((_c(x1) + (_c(x2) - _c(x1)) * i / (n - 1)).alias("x"), (_c(y1) + (_c(y2) - _c(y1)) * i / (n - 1)).alias("y"))
    )


def in_penalty_box(x: C, origin: str = "center") -> Column:
    """Within 16.5 m of a goal line; the other axis doesn't count. origin: ``center`` or ``corner`` of the pitch."""
    if origin == "corner":
        return (_c(x) < 16.5) | (_c(x) > PITCH_LENGTH - 16.5)
    return F.abs(_c(x)) > PITCH_LENGTH / 2 - 16.5


def cubic_y(y: C, factor: float, largest: C, height: float) -> Column:
    """y moved away from the middle by (factor - 1) times its cube; pixels (largest over 1) are shares of the height."""
    unit = F.when(_c(largest) > 1, F.lit(height)).otherwise(F.lit(1.0))
    mid = _c(y) / unit - 0.5
    return (mid + (factor - 1) * mid * mid * mid + 0.5) * unit
