"""What must not change, and what must not be carried along, as tables grow."""

import datetime
import math

import numpy as np

from fieldglass import registry
from fieldglass.operators import calibration as C
from fieldglass.operators import cluster, evaluation, matching, robust, tracks, walk

GOALS = "match_id long, frame_id long, goal_id long, x double, y double, px double, confidence double"
LINES = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


def lineitem(spark, path, rows):
    """A folder with a lineitem table of rows (order, line, x, y), the places of their boxes."""
    x, y = {k * 37 % 1920: k for k in range(1920)}, {k * 53 % 1080: k for k in range(1080)}
    day = datetime.datetime(2000, 1, 1)
    spark.createDataFrame([(o, x[a], y[b], n, 1.0, 1.0, 0.0, 0.0, "A", "F", day) for o, n, a, b in rows], LINES).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_smoothed_goals_are_the_same_in_any_blocks(spark):
    rows = [(m, f, g, 100.0 + 9 * f % 70 + 40 * g, 50.0, (-1.0) ** g, 0.5 + 0.1 * g) for m in range(2) for f in range(0, 60, 2) for g in range(4)]
    goals = spark.createDataFrame(rows, GOALS)
    rounded = lambda df: sorted((*r[:3], round(r.x, 9), round(r.y, 9), r.n, round(r.confidence, 9)) for r in df.collect())
    one = rounded(C.smoothed_goals(goals))
    assert one and all(rounded(C.smoothed_goals(goals, block=b)) == one for b in (3, 16))


def test_smoothed_goals_walk_once_over_uncopied_goals(spark):
    goals = spark.createDataFrame([(0, f, 0, 100.0 + f, 50.0, -52.5, 0.5) for f in range(3)], GOALS)
    physical = plan(C.smoothed_goals(goals)).split("== Physical Plan ==")[1]
    assert physical.count("MapInPandas") == 1


def test_stored_mismatches_at_exactly_twenty(spark, tmp_path):
    """400 / 20 is not over 20, wherever the two boxes are."""
    at = next(a for a in range(1500) if (a + 400) / 20 - a / 20 > 20)
    (row,) = registry.QUERIES["stored_mismatches"](spark, lineitem(spark, tmp_path, [(1, 1, at, 5), (1, 2, at + 400, 5)])).collect()
    assert (row.distance, row.mismatch, row.far) == (20.0, True, False)


def test_islands_in_step_are_walked_like_each_alone():
    """Islands of several lengths, the last of each chunk going on in the next, against a tracker for each."""
    rng = np.random.default_rng(1)
    islands = [[(t, n := int(rng.integers(1, 5)), rng.integers(0, 40, (n, 4)) + 20.0, np.sort(rng.random(n))[::-1], rng.integers(0, 2, n)) for t in np.flatnonzero(rng.random(k) < 0.8)] for k in (30, 90, 5, 40)]
    want = [[tracks.Tracker.frame(t, b, c, k, int(tick)).tolist() for tick, _, b, c, k in i] for i in islands for t in [tracks.Tracker(0.5, 0.1, 0.3, 8)]]
    got, many = [[] for _ in islands], tracks.Trackers(0.5, 0.1, 0.3, 8)
    for chunk, new in (([(0, 0, 30), (1, 0, 20)], True), ([(1, 20, 90), (2, 0, 5), (3, 0, 40)], False)):
        many.begin(len(chunk), new)
        parts = [islands[i][a:b] for i, a, b in chunk]
        for s in range(max(map(len, parts))):
            now = [(lane, p[s]) for lane, p in enumerate(parts) if s < len(p)]
            size = [f[1] for _, f in now]
            cat = [np.concatenate([f[c] for _, f in now]) for c in (2, 3, 4)]
            ids = many.frames(np.repeat([lane for lane, _ in now], size), *cat, np.repeat([f[0] for _, f in now], size))
            for (lane, _), part in zip(now, np.split(ids, np.cumsum(size)[:-1]), strict=True):
                got[chunk[lane][0]].append(part.tolist())
    assert got == want


def test_clusters_of_many_groups_at_once(spark):
    """Groups of several sizes in one batch; a plan without columns that the walk doesn't need."""
    rows = [(g, float(i % n), 40.0 * (i * i % 7), 10.0 * i) for g, n in enumerate((1, 2, 5, 5, 70)) for i in range(n)]
    pts = spark.createDataFrame(rows, "g long, i double, x double, y double")
    for clusters, rule in ((lambda: cluster.linked_clusters(pts, ["g"], 60.0), "linked"), (lambda: cluster.leader_clusters(pts, ["g"], ["i"], 60.0, "mean"), "mean")):
        got = {}
        for r in clusters().collect():
            got.setdefault(r.g, {})[r.x, r.y] = r.cluster
        for g in got:
            p = sorted((x, y) if rule == "linked" else (y, x) for k, _, x, y in rows if k == g)
            p = p if rule == "linked" else [(x, y) for y, x in p]
            assert [got[g][q] for q in p] == (_linked(p) if rule == "linked" else _means(p))
    assert hasattr(walk, "labelled_alike")


def _linked(p):
    root = list(range(len(p)))
    for _ in p:
        root = [min(root[j] for j in range(len(p)) if math.dist(p[i], p[j]) <= 60) for i in range(len(p))]
    return [sorted(set(root)).index(r) for r in root]


def _means(p):
    found, out = [], []
    for q in p:
        k = next((k for k, c in enumerate(found) if math.dist(q, [sum(v) / len(c) for v in zip(*c, strict=True)]) < 60), len(found))
        found += [[]] * (k == len(found))
        found[k] = [*found[k], q]
        out.append(k)
    return out


def test_outliers_of_a_large_group_are_dealt_in_parts(spark):
    rows = [(1, float(i), float(i % 10)) for i in range(400)] + [(1, 1e6, 0.0), (2, 0.0, 0.0)]
    out = robust.without_outliers(spark.createDataFrame(rows, "g long, x double, y double"), ["g"])
    assert sorted(map(tuple, out.collect())) == sorted(rows[:400] + rows[401:])
    assert "_part" in plan(out).split("== Physical Plan ==")[1]


def test_ball_counts_assign_nothing(spark, tmp_path):
    """The query shows no distance, so its plan has the walk of the greedy matches alone; one walk scores all levels."""
    d = lineitem(spark, tmp_path, [(1, n, 100 * n, 5) for n in range(1, 4)])
    assert plan(registry.QUERIES["greedy_ball_counts"](spark, d)).split("== Physical Plan ==")[1].count("MapInPandas") == 1
    cand = spark.createDataFrame([(1, 0, 1, 0.9, 5, 0.6), (1, 0, 2, 0.95, 5, 0.8), (1, 0, 2, 0.95, 6, 0.9), (1, 0, 1, 0.9, 6, 0.55)], "frame_id long, class_id int, pred long, score double, target long, iou double")
    assert {(r.level, r.n) for r in matching.greedy_level_counts(cand, (0.5, 0.75)).collect()} == {(0.5, 2), (0.75, 1)}


def test_scores_read_and_deal_the_boxes_once(spark, tmp_path):
    """One scan; shuffles for the numbers, the frames and the classes; no pairs or frames as rows of a join."""
    d = lineitem(spark, tmp_path, [(1, n, 100 * n, 5) for n in range(1, 4)])
    physical = plan(registry.QUERIES["detection_scores"](spark, d)).split("== Physical Plan ==")[1]
    assert (physical.count("FileScan"), physical.count("Exchange"), physical.count("Join")) == (1, 3, 0)


def test_scores_of_many_images_against_a_plain_walk(spark):
    """Images with one side only, more predictions than count, equal scores and IoUs, scores and classes that are null."""
    rng = np.random.default_rng(4)
    side = lambda most: [(f, c, n, float(rng.integers(0, 4)) if rng.random() < 0.9 else None, *map(float, rng.integers(0, 3, 2) * 2), 10.0, 10.0) for f in range(60) for n, c in enumerate(rng.choice([0, 1, None], rng.integers(0, most), p=[0.5, 0.4, 0.1]), 1)]
    schema = "frame_id long, class_id int, det_id long, confidence double, x double, y double, w double, h double"
    pred, gt = side(9), side(6)
    for strict in (False, True):
        got = evaluation.evaluate(spark.createDataFrame(pred, schema), spark.createDataFrame(gt, schema), strict=strict, most=5).collect()
        assert {(r.class_id, r.iou, r.tp, r.predictions, r.targets) for r in got} == _scores(pred, gt, strict, 5) and len(got) == 6


def _scores(pred, gt, strict, most):
    first = lambda r: (r[3] is None, -(r[3] or 0), -r[2])
    p = [r for f in range(60) for r in sorted((r for r in pred if r[0] == f), key=first)[:most]]
    both = range(60) if strict else {r[0] for r in p} & {r[0] for r in gt}
    out = set()
    for level in (0.5, 0.75):
        for c in (0, 1, None):
            taken = set()
            for q in p:
                inter = [(max(10 - abs(q[4] - t[4]), 0) * max(10 - abs(q[5] - t[5]), 0), -t[2], t) for t in gt if t[:2] == q[:2] and q[1] == c is not None and (t[0], t[2]) not in taken]
                best = max((i / (200 - i), n, t) for i, n, t in inter) if inter else (0,)
                taken |= {(best[2][0], best[2][2])} if best[0] >= level else set()
            out.add((c, level, len(taken), *(sum(r[1] == c and r[0] in both for r in s) for s in (p, gt))))
    return out
