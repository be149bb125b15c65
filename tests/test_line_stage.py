"""The line stage: frames of any size against SQL, odd rows, and that neither pairs nor votes become rows."""

import datetime
import random

import duckdb
import numpy as np
import pytest

from fieldglass import registry
from fieldglass.operators import line_walk
from fieldglass.operators import lines as O

from .test_growth import LINES, plan
from .test_queries import _plain

SEGMENTS = "frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    """Frames of 1 to 150 lines: over 20 lines have more pairs than are tried, over 64 are walked alone."""
    rng, d = random.Random(3), str(tmp_path_factory.mktemp("frames"))
    rows = [
        (o, rng.randrange(9999), rng.randrange(9999), k, float(rng.randint(1, 50)), 1.0 * k, 0.0, 0.0, "A", "F", datetime.datetime(2000, 1, 1))
        for o, n in enumerate((1, 2, 3, 7, 20, 21, 22, 40, 64, 65, 150, 4))
        for k in range(n)
    ]
    spark.createDataFrame(rows, LINES).write.parquet(f"{d}/lineitem.parquet")
    return d


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet/*.parquet'")
    found = con.execute(registry.ORACLE_SQL[name])
    cols, df = [c[0] for c in found.description], registry.QUERIES[name](spark, d)
    want = sorted(tuple(map(_plain, r)) for r in found.fetchall())
    assert want and sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect()) == want


def one_walk(spark, d, name):
    physical = plan(registry.QUERIES[name](spark, d)).split("== Physical Plan ==")[1]
    return physical.count("MapInPandas") == 1 and "Join" not in physical and physical.count("Scan parquet") == 1


def test_merged_directions_of_frames_of_any_size(spark, frames):
    same_as_sql(spark, frames, "merged_directions")
    assert one_walk(spark, frames, "merged_directions")


def test_merged_directions_of_odd_rows(spark):
    """Segments without a length, a place or a frame go, and frames whose lines never cross."""
    rows = [(1, 1, 0.0, 0.0, 9.0, 0.0), (1, 2, 0.0, 5.0, 0.0, 9.0), (1, 3, 7.0, 7.0, 7.0, 7.0), (1, 4, None, 1.0, 2.0, 3.0), (2, 1, 0.0, 0.0, 9.0, 0.0), (2, 2, 0.0, 1.0, 9.0, 1.0)]
    rows += [(None, k, *r[2:]) for k, r in enumerate(rows)]
    segments = spark.createDataFrame(rows, SEGMENTS)
    got = O.merged_by_direction(segments, ["frame_id"], "det_id").collect()
    assert sorted((r.frame_id, r.longitudinal, r.line) for r in got) == [(1, True, 1), (1, True, 2)]
    assert O.merged_by_direction(segments.limit(0), ["frame_id"], "det_id").count() == 0


def test_vanishing_points_of_frames_of_any_size(spark, frames):
    same_as_sql(spark, frames, "vanishing_points")
    assert one_walk(spark, frames, "vanishing_points")


def test_vanishing_points_are_rounded_as_in_sql(spark, tmp_path):
    """480.47499999999997 times 100 is 48047.5."""
    lines = [(25753, 1955, 3, 26.0), (34000, 1020, 4, 20.0), (39658, 1900, 6, 33.0), (39984, 1398, 6, 19.0)]
    rows = [(154934, *r, 1.0, 0.0, 0.0, "A", "F", datetime.datetime(2000, 1, 1)) for r in lines]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    same_as_sql(spark, tmp_path, "vanishing_points")
    assert registry.QUERIES["vanishing_points"](spark, str(tmp_path)).first().vx == 480.48


def test_line_keypoints_of_frames_of_any_size(spark, frames):
    same_as_sql(spark, frames, "line_keypoints")
    assert one_walk(spark, frames, "line_keypoints")


def test_keypoints_in_any_lots():
    """Two frames whose crossings are taken in lots of a few, against one after the other."""
    rng = np.random.default_rng(2)
    of, along = np.repeat([0, 1, 2], [30, 5, 4]), np.concatenate([np.arange(30) < 16, np.arange(5) < 2, np.ones(4, bool)])
    angle = rng.random(39) * 3
    abc, line = [np.cos(angle), np.sin(angle), rng.random(39) * -400], np.arange(39) * 10
    want = []
    for f in range(3):
        kept = []
        for i in np.flatnonzero((of == f) & along):
            for j in np.flatnonzero((of == f) & ~along):
                x, y, ok = line_walk.crossings([v[i] for v in abc], [v[j] for v in abc])
                if ok and 0 <= x <= 500 and 0 <= y <= 500 and all(np.sqrt((x - p) ** 2 + (y - q) ** 2) >= 15 for _, _, p, q in kept):
                    kept.append((line[i], line[j], x, y))
        want += [(f, *k) for k in kept]
    for most in (1, 7, 4_000_000):
        frame, p = line_walk.keypoints(of, along, line, abc, (0, 500, 0, 500), 15.0, most)
        assert want and list(zip(frame, p["i"], p["j"], p["x"], p["y"], strict=True)) == want
