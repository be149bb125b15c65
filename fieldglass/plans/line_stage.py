"""The line stage of a frame: vanishing point, directions, merged lines, their crossings as keypoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines as O
from ..registry import query
from .lines import _SEG, segments

_LINES = _SEG.replace("WITH ", "WITH RECURSIVE ", 1) + """,
  ln AS (SELECT *, (y2 - y1) / n AS a, (x1 - x2) / n AS b, -((y2 - y1) * x1 + (x1 - x2) * y1) / n AS c,
    CASE WHEN atan2(x2 - x1, -(y2 - y1)) < 0 THEN atan2(x2 - x1, -(y2 - y1)) + pi() ELSE
      atan2(x2 - x1, -(y2 - y1)) END * 500.0 AS theta, (x1 * -(y2 - y1) + y1 * (x2 - x1)) / n AS rho
    FROM (SELECT *, sqrt((y2 - y1) * (y2 - y1) + (x1 - x2) * (x1 - x2)) AS n FROM seg) WHERE n > 0),
  two AS (SELECT l.frame_id, l.det_id AS i, r.det_id AS j, l.a * r.b - r.a * l.b AS det, l.b * r.c - r.b * l.c AS nx, r.a * l.c - l.a * r.c AS ny
    FROM ln l JOIN ln r ON l.frame_id = r.frame_id AND l.det_id < r.det_id),
  tried AS (SELECT frame_id, i, j, nx / det AS hx, ny / det AS hy FROM two WHERE abs(det) >= 1e-10 QUALIFY
    row_number() OVER (PARTITION BY frame_id ORDER BY md5(i || '-' || j), i, j) <= 200),
  votes AS (SELECT h.frame_id, i, j, hx, hy, count(*) AS votes, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * c) AS ac, sum(b * c) AS bc
    FROM tried h JOIN ln l ON l.frame_id = h.frame_id AND abs(a * hx + b * hy + c) < 50 GROUP BY h.frame_id, i, j, hx, hy),
  best AS (SELECT *, aa * bb - ab * ab AS det FROM votes QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY votes DESC, i, j) = 1),
  vp AS (SELECT frame_id, votes, CASE WHEN det > 1e-9 THEN (ab * bc - bb * ac) / det ELSE hx END AS vx, CASE WHEN det > 1e-9 THEN (ab * ac - aa * bc) / det ELSE hy END AS vy FROM best)"""
_MERGED = _LINES + """,
  sided AS (SELECT ln.*, abs(a * vx + b * vy + c) < 150 AS longitudinal FROM ln JOIN vp USING (frame_id)),
  near AS (SELECT l.frame_id, l.longitudinal, l.det_id AS u, r.det_id AS v FROM sided l JOIN sided r ON l.frame_id = r.frame_id AND l.longitudinal = r.longitudinal
    AND sqrt((l.rho - r.rho) * (l.rho - r.rho) + (l.theta - r.theta) * (l.theta - r.theta)) <= sqrt(1025.0)),
  reach AS (SELECT frame_id, longitudinal, u, v FROM near UNION SELECT r.frame_id, r.longitudinal, r.u, n.v FROM reach r
    JOIN near n ON n.frame_id = r.frame_id AND n.longitudinal = r.longitudinal AND n.u = r.v),
  label AS (SELECT frame_id, longitudinal, u, min(v) AS line FROM reach GROUP BY frame_id, longitudinal, u),
  mean AS (SELECT s.frame_id, s.longitudinal, line, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM sided s JOIN label ON label.frame_id = s.frame_id
    AND label.u = s.det_id GROUP BY s.frame_id, s.longitudinal, line),
  merged AS (SELECT frame_id, longitudinal, line, a / sqrt(a * a + b * b) AS a, b / sqrt(a * a + b * b) AS b, c / sqrt(a * a + b * b) AS c FROM mean WHERE sqrt(a * a + b * b) >= 1e-10)"""
_MET = _MERGED + """,
  met AS (SELECT l.frame_id, l.line AS i, r.line AS j, (l.b * r.c - r.b * l.c) / (l.a * r.b - r.a * l.b) AS x, (r.a * l.c - l.a * r.c) / (l.a * r.b - r.a * l.b) AS y
    FROM merged l JOIN merged r ON l.frame_id = r.frame_id AND l.longitudinal AND NOT r.longitudinal AND abs(l.a * r.b - r.a * l.b) >= 1e-10),
  inside AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY i, j) AS r FROM met WHERE x BETWEEN -480 AND 2400 AND y BETWEEN -270 AND 1350),
  close AS (SELECT p.frame_id, p.i, p.j, p.x, p.y, p.r, list(q.r) FILTER (WHERE q.r IS NOT NULL) AS ns FROM inside p LEFT JOIN inside q ON q.frame_id = p.frame_id AND q.r < p.r
    AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) < 15 GROUP BY p.frame_id, p.i, p.j, p.x, p.y, p.r),
  walk AS (SELECT frame_id, i, j, x, y, r, [r] AS kept, TRUE AS stays FROM close WHERE r = 1
    UNION ALL SELECT n.frame_id, n.i, n.j, n.x, n.y, n.r, CASE WHEN len(list_intersect(coalesce(n.ns, []), w.kept)) > 0 THEN w.kept ELSE list_append(w.kept, n.r) END,
      len(list_intersect(coalesce(n.ns, []), w.kept)) = 0 FROM walk w JOIN close n ON n.frame_id = w.frame_id AND n.r = w.r + 1)"""


def _rounded(c, digits):
    """As DuckDB rounds: the multiple of a power of ten to a whole number, halves away from 0."""
    return (F.round(F.col(c) * 10.0**digits) / 10.0**digits).alias(c)


@query(_LINES + " SELECT frame_id, votes, round(vx, 2) AS vx, round(vy, 2) AS vy FROM vp WHERE abs(vx) < 20000 AND abs(vy) < 20000")
def vanishing_points(spark, d):
    """The point that most lines of a frame pass by, of those that are not too far to tell."""
    v = O.vanishing_points(segments(spark, d), ["frame_id"], "det_id").filter((F.abs("vx") < 20000) & (F.abs("vy") < 20000))
    return v.select("frame_id", "votes", _rounded("vx", 2), _rounded("vy", 2))


@query(_MERGED + " SELECT frame_id, longitudinal, line, round(a, 6) AS a, round(b, 6) AS b, round(c, 3) AS c FROM merged")
def merged_directions(spark, d):
    """Lines merged from the segments of each direction."""
    m = O.merged_by_direction(segments(spark, d), ["frame_id"], "det_id")
    return m.select("frame_id", "longitudinal", "line", _rounded("a", 6), _rounded("b", 6), _rounded("c", 3))


@query(_MET + " SELECT frame_id, i, j, round(x, 3) AS x, round(y, 3) AS y FROM walk WHERE stays")
def line_keypoints(spark, d):
    """Crossings of merged longitudinal and transversal lines, each away from those before it."""
    k = O.line_keypoints(segments(spark, d), ["frame_id"], "det_id", 1920, 1080)
    return k.select("frame_id", "i", "j", _rounded("x", 3), _rounded("y", 3))
