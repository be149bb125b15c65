"""Ordered streams equal their batch operators: late, repeated and unordered files, restarts, bounded state."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import tracks
from fieldglass.operators.tracks import Tracker
from fieldglass.streaming import frames as S
from fieldglass.streaming import ordered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOX = S.DETECTIONS + ", cut boolean"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def boxes(frames=60, matches=2, seed=1):
    """A few moving players and a ball, boxes missing now and then, two scene cuts."""
    rnd = random.Random(seed)
    out = []
    for m in range(matches):
        at = {k: [rnd.uniform(0, 1500), rnd.uniform(0, 800), rnd.uniform(-9, 9), rnd.uniform(-9, 9)] for k in range(5)}
        for f in range(frames):
            cut = f in (20, 45)
            if cut:
                at = {k: [rnd.uniform(0, 1500), rnd.uniform(0, 800), rnd.uniform(-9, 9), rnd.uniform(-9, 9)] for k in range(5)}
            for k, p in at.items():
                p[0] += p[2] + rnd.uniform(-3, 3) * (k != 4)
                p[1] += p[3]
                if rnd.random() < 0.8:
                    conf = rnd.choice([0.9, 0.7, 0.7, 0.3, 0.05])
                    w = 40.0 if k == 4 else 90.0
                    out.append((m, f, k, int(k == 4), conf, p[0], p[1], w, 2 * w, float(f), cut))
    return out


def batch(spark, rows):
    return spark.createDataFrame(rows, BOX)


def put(folder, k, rows, columns):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{k:03d}.json"
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(dict(zip(columns, r, strict=True))) for r in rows))
    os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))


def single_walk(rows, buffer=30):
    """Track ids of one match by one walk, without Spark."""
    tracker, out = Tracker(0.5, 0.1, 0.3, buffer), {}
    import numpy as np

    for f in sorted({r[1] for r in rows}):
        now = sorted((r for r in rows if r[1] == f), key=lambda r: (-r[4], r[2]))
        if any(r[10] for r in now):
            tracker.cut()
        ids = tracker.frame(np.array([r[5:9] for r in now]), np.array([r[4] for r in now]), np.array([r[3] for r in now]))
        out |= {(f, r[2]): i for r, i in zip(now, ids.tolist(), strict=True) if i >= 0}
    return out


def test_islands_equal_one_walk(spark):
    rows = boxes(90, 1)
    rows = [(*r[:4], 0.05 if 55 < r[1] < 75 else r[4], *r[5:]) for r in rows]  # no box to track for nineteen updates
    got = tracks.associate(batch(spark, rows), buffer=10, cut="cut").collect()
    assert {(r.frame_id, r.det_id): r.track_id for r in got} == single_walk(rows, 10)
    found = tracks.islands(batch(spark, rows), buffer=10, cut="cut")
    assert found.select("island").distinct().count() == 4
    assert tracks.associate(batch(spark, rows[:0]), cut="cut").count() == 0


def test_stream_of_boxes_equals_batch(rocks, tmp_path):
    spark, rows = rocks, boxes()
    names = [c.split()[0] for c in BOX.split(", ")]
    rnd = random.Random(3)
    files = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for m in (0, 1):
        for f in files:
            f.sort(key=lambda r: rnd.random())
    files = [files[i] for k in range(0, len(files), 2) for i in (k + 1, k) if i < len(files)]  # each second file is late
    files = [[r for f in files for r in f if r[0] == m] for m in (0, 1)]  # one match after the other, then interleaved
    parts = [f[i : i + 40] for f in zip(*[[f[i : i + 40] for i in range(0, len(f), 40)] for f in files], strict=False) for f in f for i in (0,)]
    left = [r for r in rows if not any(r in p for p in parts)]
    parts += [left, parts[0]] if left else [parts[0]]  # a file comes again
    parts.append([(m, 10**6, 0, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1e6, False) for m in (0, 1)])
    for k, p in enumerate(parts):
        put(f"{tmp_path}/in", k, p, names)
    src = S.event_time(S.watch(spark, f"{tmp_path}/in", BOX, files_each=2), 1000)
    q = S.write_event_files(ordered.associated(src), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(300)
    got = sorted((r.match_id, r.frame_id, r.det_id, r.track_id, r.status or "") for r in spark.read.schema("match_id long, frame_id long, det_id long, track_id long, status string").json(f"{tmp_path}/out").collect())
    want = tracks.validated_balls(batch(spark, rows), cut="cut").collect()
    assert got == sorted((r.match_id, r.frame_id, r.det_id, r.track_id, r.status or "") for r in want)
    assert {s for *_, s in got} >= {"", "pending", "valid"}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) < 2000


def test_stream_verdicts_equal_batch(rocks, tmp_path):
    from fieldglass.fixtures import tracks as table

    spark = rocks
    t = table(spark, "/root/testdata/sf0.001").select("track_id", "n", F.col("event_id").cast("double").alias("x"), "y").filter("n <= 12")
    rows = [tuple(r) for r in t.collect()]
    rows += [(900, n, float(n), float(n * n)) for n in (1, 2, 3, 4, 5, 6, 40, 41)]
    random.Random(2).shuffle(rows)
    timed = [(*r, f"2024-01-01T00:00:{r[1]:02d}Z") for r in rows]
    timed += [(track, 10**6, 0.0, 0.0, "2024-01-02T00:00:00Z") for track in {r[0] for r in rows}]
    cut = len(rows)
    for k, i in enumerate(range(0, cut, 40)):
        put(f"{tmp_path}/in", k, timed[i : min(i + 40, cut)], ["track_id", "n", "x", "y", "time"])
    put(f"{tmp_path}/in", 900, timed[cut:], ["track_id", "n", "x", "y", "time"])
    src = S.watch(spark, f"{tmp_path}/in", "track_id long, n long, x double, y double, time timestamp", files_each=3)
    q = S.write_event_files(ordered.track_status(src.withWatermark("time", "1 hour")), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(300)
    got = sorted((r.track_id, r.n, r.incarnation, r.status) for r in spark.read.json(f"{tmp_path}/out").collect())
    points = tracks.incarnations(spark.createDataFrame(rows, "track_id long, n long, x double, y double"), "track_id", "n")
    want = tracks.ball_verdicts(points, ["track_id", "incarnation"], "n").collect()
    assert got == sorted((r.track_id, r.n, r.incarnation, r.status) for r in want)
    assert (900, 40, 1, "pending") in got and (900, 5, 0, "valid") in got


def test_checkpoints_survive_a_restart(rocks, tmp_path):
    spark = rocks
    events = [(0, f, f'{{"id": "{f}-{i}"}}', f"2024-01-01T00:{f // 60:02d}:{f % 60:02d}Z") for f in range(0, 70, 3) for i in range(1 + f % 2)]
    names = ["match_id", "end_frame", "event", "time"]

    def run(folder, stops):
        for k, i in enumerate(range(0, len(events), 7)):
            put(f"{tmp_path}/{folder}/in", k, events[i : i + 7], names)
            if k in stops:
                start(folder)
        put(f"{tmp_path}/{folder}/in", 900, [(0, 10**6, "end", "2024-01-02T00:00:00Z")], names)
        start(folder)
        return sorted(tuple(r) for r in spark.read.json(f"{tmp_path}/{folder}/out").select("checkpoint", "end_frame", "event").collect())

    def start(folder):
        src = S.watch(spark, f"{tmp_path}/{folder}/in", "match_id long, end_frame long, event string, time timestamp", files_each=1)
        found = ordered.event_checkpoints(src.withWatermark("time", "5 seconds"), 5)
        ordered.write_checkpoints(found, f"{tmp_path}/{folder}/out", f"{tmp_path}/{folder}/ck").awaitTermination(300)

    whole, broken = run("whole", ()), run("broken", (1, 2))
    assert whole == broken
    numbers = {f: n for n, f in enumerate(range(0, 70, 3), 1)}
    full = len(numbers) // 5 * 5
    assert whole == sorted((-(-numbers[f] // 5) * 5, f, e) for _, f, e, _ in events if numbers[f] <= full)


def test_frozen_positions_equal_batch(rocks, tmp_path):
    from fieldglass.operators import calibration as C

    spark, rnd, rows = rocks, random.Random(5), []
    kinds = ["goal", "corner", "touchline", "penalty_box", "center_circle", None]
    for m in range(3):
        marks = [(rnd.uniform(0, 1920), rnd.uniform(0, 1080), rnd.choice(kinds)) for _ in range(14)]
        for f in range((8, 14, 25)[m]):  # the first match is too short for a model
            for i, (x, y, kind) in enumerate(marks):
                x, y = x + rnd.uniform(-4, 4), y + rnd.uniform(-4, 4)
                if i == 2 and f == 3:
                    x += 30  # within the cluster, outside its quartiles
                w = 0.0002 * y + 1
                rows.append((m, f, i, x, y, kind, (0.06 * x - 55) / w, (0.08 * y - 40) / w, 0.8, float(f)))
    schema = "match_id long, frame_id long, det_id long, x double, y double, type string, px double, py double, confidence double, ts double"
    names = [c.split()[0] for c in schema.split(", ")]
    rnd.shuffle(rows)
    for k, i in enumerate(range(0, len(rows), 150)):
        put(f"{tmp_path}/in", k, rows[i : i + 150], names)
    put(f"{tmp_path}/in", 900, [(m, 10**6, 0, 0.0, 0.0, None, 0.0, 0.0, 0.0, 1e6) for m in range(3)], names)
    src = S.event_time(S.watch(spark, f"{tmp_path}/in", schema, files_each=2), 1000)
    S.write_event_files(ordered.frozen_positions(src), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(300)
    got = {(r.match_id, r.frame_id, r.det_id): (r.px, r.py, r.model) for r in spark.read.json(f"{tmp_path}/out").collect()}
    points = spark.createDataFrame(rows, schema)
    models = C.frozen_homographies(points.filter("type IS NOT NULL"))
    assert sorted(r.match_id for r in models.collect()) == [1, 2]
    det = points.select("match_id", "frame_id", "det_id", "x", "y")
    want = {(r.match_id, r.frame_id, r.det_id): (r.px, r.py, r.model) for r in C.calibrated(det, models, frames=10**6).collect()}  # no second pass
    assert got.keys() == want.keys() and {v[2] for v in got.values()} == {"fallback", "frozen"}
    for k, (px, py, model) in want.items():
        assert got[k][2] == model and abs(got[k][0] - px) < 1e-6 and abs(got[k][1] - py) < 1e-6
