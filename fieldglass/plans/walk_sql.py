"""Order-dependent rules as recursive SQL: one step for each row of a small group, the state in lists."""

from __future__ import annotations

from ..fixtures import sql

_DET = sql("det").replace("WITH ", "WITH RECURSIVE ", 1)
_INTER = "greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def _ordered(keys: str, order: str, where: str = "TRUE") -> str:
    return f"o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS r FROM det WHERE {where})"


def _near(keys: list[str], cond: str) -> str:
    """Each row with the places of the earlier rows of its group that fulfil cond."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    names = ", ".join(f"a.{k}" for k in keys)
    return f"near AS (SELECT {names}, a.det_id, a.confidence, a.r, list(b.r ORDER BY b.r) FILTER (WHERE b.r IS NOT NULL) AS ns FROM o a LEFT JOIN o b ON {on} AND b.r < a.r AND {cond} GROUP BY {names}, a.det_id, a.confidence, a.r)"


def _kept(keys: list[str], order: str, cond: str, columns: str) -> str:
    """Rows are kept in order unless one that was kept before fulfils cond with them."""
    ks, on = ", ".join(keys), " AND ".join(f"n.{k} = w.{k}" for k in keys)
    over = "len(list_intersect(coalesce(n.ns, []), w.kept)) > 0"
    return f"""{_DET}, {_ordered(ks, order)}, {_near(keys, cond)},
  walk AS (SELECT {ks}, det_id, confidence, r, [r] AS kept, TRUE AS stays FROM near WHERE r = 1
    UNION ALL SELECT {", ".join("n." + k for k in keys)}, n.det_id, n.confidence, n.r, CASE WHEN {over} THEN w.kept ELSE list_append(w.kept, n.r) END, NOT ({over}) FROM walk w JOIN near n ON {on} AND n.r = w.r + 1)
  SELECT {columns} FROM walk WHERE stays"""


NMS = _kept(
    ["frame_id", "class_id"],
    "confidence DESC, det_id",
    f"{_INTER} > 0.5 * greatest(a.w * a.h + b.w * b.h - {_INTER}, 1e-6)",
    "frame_id, class_id, det_id, confidence"
)
SPACED = _kept(["frame_id"], "confidence DESC, det_id", "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 60", "frame_id, det_id")
#: A row joins the first seed that is near; its cluster is the seed's place among the seeds.
LEADER = f"""{_DET}, {_ordered("frame_id, class_id", "det_id")}, {_near(["frame_id", "class_id"], "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 50")},
  walk AS (SELECT frame_id, class_id, det_id, r, [r] AS seeds, CAST(0 AS BIGINT) AS cluster FROM near WHERE r = 1
    UNION ALL SELECT n.frame_id, n.class_id, n.det_id, n.r,
      CASE WHEN len(list_intersect(coalesce(n.ns, []), w.seeds)) > 0 THEN w.seeds ELSE list_append(w.seeds, n.r) END,
      CASE WHEN len(list_intersect(coalesce(n.ns, []), w.seeds)) > 0 THEN CAST(list_position(w.seeds, list_min(list_intersect(n.ns, w.seeds))) - 1 AS BIGINT) ELSE CAST(len(w.seeds) AS BIGINT) END
    FROM walk w JOIN near n ON n.frame_id = w.frame_id AND n.class_id = w.class_id AND n.r = w.r + 1)
  SELECT frame_id, class_id, det_id, cluster FROM walk"""
#: Reachable rows by links; clusters are numbered by their first row.
LINKED = f"""{_DET}, {_ordered("frame_id", "x, y, det_id")},
  e AS (SELECT a.frame_id, a.r AS s, b.r AS t FROM o a JOIN o b ON a.frame_id = b.frame_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 120),
  reach AS (SELECT frame_id, s, t FROM e UNION SELECT c.frame_id, c.s, e.t FROM reach c JOIN e ON e.frame_id = c.frame_id AND e.s = c.t),
  first AS (SELECT frame_id, s, min(t) AS m FROM reach GROUP BY frame_id, s)
  SELECT o.frame_id, o.det_id, CAST(dense_rank() OVER (PARTITION BY o.frame_id ORDER BY first.m) - 1 AS BIGINT) AS cluster FROM o JOIN first ON first.frame_id = o.frame_id AND first.s = o.r"""


def greedy(candidates: str, level: str) -> str:
    """Views o and walk: predictions of c(frame_id, class_id, pred, target, iou) in order, each with its best free target.

    candidates is the SQL up to the views p and c; level the condition on iou.
    """
    free = "list_filter(o.ts, lambda x: NOT list_contains(w.used, x))"
    return candidates.replace("WITH ", "WITH RECURSIVE ", 1) + f""", s AS (SELECT c.frame_id, c.class_id, c.pred, p.confidence, list(c.target ORDER BY c.iou DESC, c.target) AS ts FROM c JOIN p ON p.frame_id = c.frame_id AND p.det_id = c.pred WHERE {level} GROUP BY c.frame_id, c.class_id, c.pred, p.confidence),
  o AS (SELECT *, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY confidence DESC, pred DESC) AS r FROM s),
  walk AS (SELECT frame_id, class_id, r, pred, ts[1] AS target, [ts[1]] AS used FROM o WHERE r = 1
    UNION ALL SELECT o.frame_id, o.class_id, o.r, o.pred, {free}[1], list_concat(w.used, {free}[1:1]) FROM walk w JOIN o ON o.frame_id = w.frame_id AND o.class_id = w.class_id AND o.r = w.r + 1)"""
