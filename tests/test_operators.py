"""Small hand-made cases and invariants of the operators that SQL can't express."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.functions import geometry as G
from fieldglass.functions import labels as L
from fieldglass.operators import cluster, datasets, evaluation, frames, landmarks, matching, robust, tracks

DET = "match_id long, frame_id long, det_id long, class_id int, confidence double, x double, y double, w double, h double, ts double"


def boxes(spark, rows):
    return spark.createDataFrame([(0, f, i, c, conf, float(x), float(y), float(w), float(h), f * 1.0) for f, i, c, conf, x, y, w, h in rows], DET)


def test_nms_keeps_best_and_disjoint(spark):
    det = boxes(spark, [(1, 1, 0, 0.9, 0, 0, 10, 10), (1, 2, 0, 0.8, 1, 1, 10, 10), (1, 3, 0, 0.7, 100, 0, 10, 10), (2, 1, 0, 0.1, 0, 0, 10, 10)])
    kept = cluster.suppress_overlaps(det, ["frame_id", "class_id"]).select("frame_id", "det_id").collect()
    assert sorted(map(tuple, kept)) == [(1, 1), (1, 3), (2, 1)]


def test_nms_ignores_row_order(spark):
    rng = np.random.default_rng(0)
    rows = [(f, i, 0, round(float(rng.random()), 2), *rng.integers(0, 60, 2), *rng.integers(5, 30, 2)) for f in range(20) for i in range(12)]
    a = cluster.suppress_overlaps(boxes(spark, rows), ["frame_id"]).select("frame_id", "det_id")
    b = cluster.suppress_overlaps(boxes(spark, rows[::-1]).repartition(7), ["frame_id"]).select("frame_id", "det_id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (4, 4), (5, 3)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        c = rng.random(shape)
        got = matching.assignment(c)
        small, large = sorted(shape)
        assert len(got) == small and len({i for i, _ in got}) == small and len({j for _, j in got}) == small
        t = c if shape[0] <= shape[1] else c.T
        best = min(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert abs(sum(c[i, j] for i, j in got) - best) < 1e-9


def test_greedy_is_one_to_one(spark):
    cand = spark.createDataFrame(
        [(1, 0, 1, 0.9, 5, 0.6), (1, 0, 2, 0.95, 5, 0.7), (1, 0, 2, 0.95, 6, 0.6), (1, 0, 1, 0.9, 6, 0.55)],
        "frame_id long, class_id int, pred long, score double, target long, iou double"
    )
    got = sorted((r.pred, r.target) for r in matching.greedy_matches(cand).collect())
    assert got == [(1, 6), (2, 5)]


def test_scores(spark):
    gt = boxes(spark, [(1, 1, 0, 1.0, 0, 0, 10, 10), (1, 2, 1, 1.0, 50, 50, 4, 4), (3, 1, 0, 1.0, 0, 0, 5, 5)])
    pred = boxes(spark, [(1, 1, 0, 0.9, 0, 0, 10, 10), (1, 2, 0, 0.8, 30, 0, 10, 10), (2, 1, 0, 0.9, 0, 0, 5, 5)])
    got = {(r.class_id, r.iou): (r.tp, r.predictions, r.targets) for r in evaluation.evaluate(pred, gt).collect()}
    assert got[0, 0.5] == (1, 2, 1)
    strict = {(r.class_id, r.iou): (r.tp, r.predictions, r.targets) for r in evaluation.evaluate(pred, gt, strict=True).collect()}
    assert strict[0, 0.5] == (1, 3, 2) and strict[1, 0.5] == (0, 0, 1)


def test_clusters(spark):
    pts = spark.createDataFrame([(1, i, float(x), 0.0) for i, x in enumerate([0, 40, 80, 200])], "g int, i int, x double, y double")
    lab = lambda df: [r.cluster for r in df.orderBy("i").collect()]
    assert lab(cluster.leader_clusters(pts, ["g"], ["i"], 50.0)) == [0, 0, 1, 2]
    assert lab(cluster.leader_clusters(pts, ["g"], ["i"], 50.0, "any")) == [0, 0, 0, 1]
    assert lab(cluster.linked_clusters(pts, ["g"], 50.0)) == [0, 0, 0, 1]
    assert [r.i for r in cluster.spaced(pts, ["g"], ["i"], 50.0).orderBy("i").collect()] == [0, 2, 3]


def test_previous_across_intervals(spark):
    df = spark.createDataFrame([(0, f, f * 10) for f in (1, 5, 12, 40, 41)], "m int, f long, v long")
    got = frames.with_previous(df, ["m"], "f", {"f": "pf", "v": "pv"}, width=10).orderBy("f").collect()
    assert [r.pf for r in got] == [None, 1, 5, 12, 40] and [r.pv for r in got] == [None, 10, 50, 120, 400]


def test_geometry(spark):
    row = spark.range(1).select(
        *[c.alias(f"h{i}") for i, c in enumerate(G.homography([1, 0, 0, 0, 1, 0, 0, 0, 1], F.lit(3.0), F.lit(4.0)))],
        *[c.alias(f"i{i}") for i, c in enumerate(G.line_intersection((F.lit(1.0), F.lit(0.0), F.lit(-2.0)), (F.lit(0.0), F.lit(1.0), F.lit(-3.0))))],
        *[
            c.alias(f"s{i}") for i, c in enumerate(
                G.segment_intersection(tuple(map(F.lit, (0.0, 0.0, 2.0, 2.0))), tuple(map(F.lit, (0.0, 2.0, 2.0, 0.0))))
            )
        ],
        *[
            c.alias(f"n{i}") for i, c in enumerate(
                G.segment_intersection(tuple(map(F.lit, (0.0, 0.0, 1.0, 0.0))), tuple(map(F.lit, (0.0, 1.0, 1.0, 1.0))))
            )
        ],
        G.iou(tuple(map(F.lit, (0.0, 0.0, 2.0, 2.0))), tuple(map(F.lit, (1.0, 0.0, 3.0, 2.0)))).alias("iou"),
        G.quad_area([(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0))]).alias("area"),
        F.size(G.tiles(F.lit(640), F.lit(640))).alias("one"), F.size(G.tiles(F.lit(1920), F.lit(1080))).alias("many"),
        F.size(G.corner_tiles(F.lit(1920), F.lit(1080))).alias("five"), F.size(G.circle_points(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("circle"),
        G.in_penalty_box(F.lit(40.0)).alias("box"), G.in_penalty_box(F.lit(40.0), "corner").alias("corner_box"),
    ).first()
    assert (row.h0, row.h1, row.i0, row.i1, row.s0, row.s1, row.n0) == (3, 4, 2, 3, 1, 1, None)
    assert abs(row.iou - 1 / 3) < 1e-9 and row.area == 2 and row.one == 1 and row.many == 8 and row.five == 5 and row.circle == 12
    assert row.box and not row.corner_box


def test_labels(spark):
    row = spark.range(1).select(
        L.csv_confidence(F.lit(0.0)).alias("c"),
        L.stem(F.lit("/a/b.c/d_1.jpg")).alias("s"),
        L.annotations_name(F.lit("m.mp4")).alias("a"),
        L.frame_name(F.lit(7)).alias("f")
    ).first()
    assert tuple(row) == (1.0, "d_1", "m_annotations.xml", "frame_000007.jpg")


def test_landmarks(spark):
    t = landmarks.landmark_table(spark).toPandas()
    assert len(t) == 42 and t.name.is_unique and abs(t.x).max() == 52.5 and abs(t.y).max() == 34
    assert t.groupby("priority").size().to_dict() == {1: 8, 2: 20, 3: 14}


def test_trajectories(spark):
    free = [(1, i, 2.0 * i, 5.0 + 3 * i - 0.5 * i * i) for i in range(8)]
    wild = [(2, i, [0.0, 90.0, 3.0, 80.0, 1.0, 70.0][i % 6], [0.0, 80.0, 1.0, 95.0, 2.0, 90.0][i % 6]) for i in range(6)]
    short = [(3, i, 0.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(free + wild + short, "t int, n long, x double, y double")
    got = {}
    for r in tracks.ball_verdicts(df, ["t"], "n").orderBy("t", "n").collect():
        got.setdefault(r.t, []).append(r.status)
    assert got[1] == ["pending"] * 4 + ["valid"] * 4 and got[2] == ["pending"] * 4 + ["noise"] * 2 and got[3] == ["pending"] * 3


def test_association_follows_boxes(spark):
    rows = [(f, 1, 0, 0.9, 10 + f, 10, 20, 20) for f in range(6)] + [(f, 2, 0, 0.9 if f % 2 else 0.3, 200 - f, 10, 20, 20) for f in range(1, 6)]
    got = tracks.associate(boxes(spark, rows)).toPandas()
    assert got.groupby("det_id").track_id.nunique().tolist() == [1, 1] and got.track_id.nunique() == 2


def test_teams(spark):
    f = spark.createDataFrame([([0.0, 0.0],), ([10.0, 10.0],), ([0.1, 0.1],), ([9.9, 9.9],)], "feature array<double>")
    centers, limit = robust.fit_teams(f)
    assert centers[0][0] < 1 < 9 < centers[1][0] and limit < 1
    t = spark.createDataFrame(
        [([0.0, 0.1], 0.0), ([30.0, 30.0], 45.0), ([30.0, 30.0], 0.0), (None, 0.0)],
        "f array<double>, px double"
    ).select(robust.assign_team(F.col("f"), centers, 1.0, F.col("px")).alias("t")).select("t.*").collect()
    assert [(r.team_id, r.role) for r in t] == [(0, "PLAYER"), (None, "GK"), (None, "REF"), (None, "PLAYER")]


def test_datasets(spark):
    ids = spark.createDataFrame([(i,) for i in range(0, 5000, 7)], "frame_id long")
    numbered = datasets.dense_ids(ids, ["frame_id"], "n", width=100).orderBy("frame_id").collect()
    assert [r.n for r in numbered] == list(range(1, len(numbered) + 1))
    parts = datasets.split(ids, "frame_id").groupBy("part").count().collect()
    share = {r.part: r["count"] for r in parts}
    assert 0.7 < share["train"] / sum(share.values()) < 0.9
    assert datasets.sample(ids, "frame_id", 10).collect() == datasets.sample(ids.repartition(5), "frame_id", 10).collect()
    manual = spark.createDataFrame([("1", 0, 1.0), ("1", 1, 2.0)], "track_id string, frame_id long, x double")
    predicted = spark.createDataFrame([(1, 1, 9.0), (1, 2, 3.0)], "track_id int, frame_id long, x double")
    got = sorted((r.track_id, r.frame_id, r.x) for r in datasets.merge_tracks(manual, predicted).collect())
    assert got == [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)]
