"""Small files of each format."""

import json
import os

import pandas as pd
from pyspark.sql import functions as F

from fieldglass.sources import annotations as A
from fieldglass.sources import results as R
from fieldglass.streaming import frames as S


def put(folder, name, text):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def test_coco(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 10}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0], "area": 12.0, "iscrowd": 0},
            {"id": 2, "image_id": 1, "category_id": 2, "bbox": [0.0, 0.0, 1.0, 1.0], "area": 1.0, "iscrowd": 0},
            {"id": 3, "image_id": 9, "category_id": 7, "bbox": [0.0, 0.0, 0.0, 1.0], "area": 0.0, "iscrowd": 0}
        ],
        "categories": [{"id": 1, "name": "player"}, {"id": 2, "name": "ball"}]
    }
    i, a, c = A.read_coco(spark, put(tmp_path, "x.json", json.dumps(doc)))
    t = A.coco_targets(i, a, c).orderBy("image_id").collect()
    assert [(r.image_id, r.x_max) for r in t] == [(1, 4.0), (2, None)]
    assert {r.issue: r.n for r in A.dataset_issues(i, a, c).collect()} == {"unknown image": 1, "unknown category": 1, "bad box": 1}


def test_wide_csv(spark, tmp_path):
    text = "TeamID,0,0,0,0,BALL,BALL,BALL,BALL\nPlayerID,7,7,7,7,,,,\nAttributes,h,l,t,w,h,l,t,w\nf,,,,,,,,\n1,10,20,30,5,0,0,0,0\n2,x,1,1,1,2,3,4,\n"
    got = sorted(map(tuple, A.read_wide_csv(spark, put(tmp_path, "w.csv", text)).collect()))
    assert got == [(1, "0", "7", 20.0, 30.0, 5.0, 10.0), (2, "BALL", "", 3.0, 4.0, 0.0, 2.0)]


def test_mot_and_yolo(spark, tmp_path):
    assert list(map(tuple, A.read_mot(spark, put(tmp_path, "m.txt", "1,2,10,20,30,8,-1,-1\n1,2,3\n")).collect())) == [(1, 2, 0.0, 16.0, 30.0, 8.0)]
    put(tmp_path, "y/img_1.txt", "0 0.5 0.5 0.1 0.2\nbad line\n")
    images = spark.createDataFrame([("img_1", 100, 50)], "stem string, width int, height int")
    r = A.read_yolo(spark, str(tmp_path / "y"), images).first()
    assert (r.class_id, r.x, r.y, r.w, r.h) == (0, 45.0, 20.0, 10.0, 10.0)


def test_cvat_and_voc(spark, tmp_path):
    xml = '<annotations><track id="0" label="player" source="auto"><box frame="0" xtl="1" ytl="2" xbr="4" ybr="1" outside="0" occluded="0" keyframe="1"><attribute name="confidence">0.5</attribute></box><box frame="1" xtl="1" ytl="2" xbr="4" ybr="6" outside="0" occluded="0" keyframe="1"><attribute name="confidence">oops</attribute></box></track><track id="1" label="ball" source="auto"><box frame="1" xtl="0" ytl="0" xbr="1" ybr="1" outside="0" occluded="0" keyframe="1"><attribute name="confidence">0.9</attribute></box></track></annotations>'
    path = put(tmp_path, "c.xml", xml)
    got = [(r.track_id, r.frame_id, r.h, r.confidence) for r in A.read_cvat(spark, path).orderBy("track_id", "frame_id").collect()]
    assert got == [(0, 0, 0.0, 0.5), (0, 1, 4.0, 1.0), (1, 1, 1.0, 0.9)]
    assert A.read_cvat(spark, path, with_first=True).select("track_id").distinct().count() == 1 and A.read_cvat(spark, path, frame=0).count() == 1
    voc = "<annotation><filename>f.jpg</filename><size><width>10</width><height>20</height></size><object><name>ball</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>4</xmax><ymax>6</ymax></bndbox></object><object><name>goal</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>4</xmax><ymax>6</ymax></bndbox></object></annotation>"
    assert [(r.filename, r.w, r.h) for r in A.read_voc(spark, put(tmp_path, "v.xml", voc)).collect()] == [("f.jpg", 3.0, 4.0)]


def test_results(spark, tmp_path):
    assert R.read_events(spark, str(tmp_path / "none.json")).count() == 0
    ev = {"match_id": "m", "events": [{"id": "pass_1", "type": "pass", "involved_players": [1, 2]}], "metadata": {"total_frames": 1}}
    assert R.read_events(spark, put(tmp_path, "e.json", json.dumps(ev))).first().involved_players == [1, 2]
    fd = [{"frame_id": 1, "players": [{"object_id": 3, "pitch_position": [1.0, 2.0]}]}, {"frame_id": 2, "players": []}]
    assert [
        (r.frame_id, r.x_pitch) for r in R.read_frame_data(spark, put(tmp_path, "fd.json", json.dumps(fd))).orderBy("frame_id").collect()
    ] == [(1, 1.0), (2, None)]
    pr = [{"frame": 4, "detections": [{"class_id": 1, "confidence": 0.5, "bbox": [1.0, 2.0, 3.0, 4.0]}]}]
    assert R.read_predictions(spark, put(tmp_path, "p.json", json.dumps(pr))).first().w == 3.0
    log = put(tmp_path, "log.jsonl", '{"epoch": 1, "loss": 0.5}\nnot json\n{"epoch": 3, "loss": 0.25}\n')
    assert R.latest_epoch(R.read_training_log(spark, log)).first().epoch == 3
    text = put(tmp_path, "log.txt", "Epoch 1 done\n loss: 0.75\nEpoch 2 done loss=0.5\n")
    assert [(r.epoch, r.loss) for r in R.read_text_log(spark, text).orderBy("epoch").collect()] == [(1, 0.75), (2, 0.5)]
    put(tmp_path, "imgs/a.JPG", "x"), put(tmp_path, "imgs/b.txt", "x")
    assert R.list_files(spark, str(tmp_path / "imgs")).count() == 1
    cal = R.read_calibration(
        spark,
        put(tmp_path, "cal.json", json.dumps({"homography": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]}))
    ).first()
    assert len(cal.homography) == 9 and cal.y_scale == 1.0


def test_writers(spark, tmp_path):
    from fieldglass import registry

    from pyspark.sql import functions as F

    none = F.lit(None).cast("struct<x: double, y: double>")
    ev = registry.QUERIES["events_all"](spark, "/root/testdata/sf0.001").withColumns({"start_location": none, "end_location": none})
    R.write_events(ev, str(tmp_path / "ev"))
    back = R.read_events(spark, str(tmp_path / "ev"))
    assert back.count() == ev.count()
    boxes = spark.createDataFrame(
        [(0, 5, "player", 2, 1.0, 2.0, 3.0, 4.0, 0.5), (0, 5, "player", 1, 1.0, 2.0, 3.0, 4.0, 0.25)],
        "match_id long, object_id long, label string, frame_id long, x double, y double, w double, h double, confidence double"
    )
    R.write_cvat(boxes, str(tmp_path / "cvat"))
    got = [(r.frame_id, r.w, r.confidence) for r in A.read_cvat(spark, str(tmp_path / "cvat")).orderBy("frame_id").collect()]
    assert got == [(1, 3.0, 0.25), (2, 3.0, 0.5)]


DETS = [
    {
        "match_id": 0,
        "frame_id": f,
        "det_id": 1,
        "class_id": f % 2,
        "confidence": 0.9,
        "x": 0.0,
        "y": 0.0,
        "w": 1.0,
        "h": 1.0,
        "ts": f * 1.0
    } for f in range(40)
]


def test_stream_counts_equal_batch(spark, tmp_path):
    for k in range(4):
        put(tmp_path, f"in/{k}.json", "\n".join(json.dumps(d) for d in DETS[k * 10 : k * 10 + 10]))
    counts = S.frame_counts(S.event_time(S.watch(spark, str(tmp_path / "in"), files_each=1)))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option(
        "checkpointLocation",
        str(tmp_path / "ck")
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("counts").agg(F.sum("players"), F.sum("balls")).first()
    assert tuple(got) == (20, 20)


def test_stream_once_each(spark, tmp_path):
    rows = [{"run": "a", "epoch": e, "time": f"2024-01-01T00:0{e}:00Z"} for e in (1, 2, 1, 3, 2)]
    for k, r in enumerate(rows):
        path = put(tmp_path, f"b/{k}.json", json.dumps(r))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    src = S.watch(spark, str(tmp_path / "b"), "run string, epoch long, time timestamp", files_each=1)
    q = S.write_event_files(S.once_each(src, ["run", "epoch"]), str(tmp_path / "once"), str(tmp_path / "ck3"))
    q.awaitTermination(120)
    assert sorted(r.epoch for r in spark.read.json(str(tmp_path / "once")).collect()) == [1, 2, 3]


def test_groups_run_over_batches():
    from fieldglass.operators import walk

    pdf = pd.DataFrame({"k": [1, 1, 2, 2, 2, 2, 3, 4, 4], "v": range(9)})
    for size in range(1, 10):
        got = []
        for whole, at in walk.groups((pdf.iloc[i : i + size] for i in range(0, 9, size)), ["k"]):
            got += [whole["v"].iloc[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == [[0, 1], [2, 3, 4, 5], [6], [7, 8]]


def test_event_document_keeps_locations(spark, tmp_path):
    from fieldglass import registry
    from fieldglass.operators import frames as O
    from fieldglass.plans import event_queries as Q

    ev = O.all_events(Q._pos(spark, "/root/testdata/sf0.001"), dribbles_reach=10.0, shots_speed=5.0, shots_goal_x=42.5)
    R.write_events(ev, str(tmp_path / "ev"))
    back = {r.id: r for r in R.read_events(spark, str(tmp_path / "ev")).collect()}
    assert all(back[r.id].start_location == r.start_location and back[r.id].end_location == r.end_location for r in ev.collect())
    assert "event_locations" in registry.ORACLE_SQL


def test_event_tags(spark, tmp_path):
    rows = [("pass", 3, 7, 0.25), ("shot", 9, None, 1.0)]
    R.write_event_tags(spark.createDataFrame(rows, "type string, start_frame long, player long, confidence double"), str(tmp_path / "tags"))
    got = sorted(map(tuple, R.read_event_tags(spark, str(tmp_path / "tags")).collect()))
    assert got == [("pass", 3, "auto", 0.25, "7"), ("shot", 9, "auto", 1.0, None)]


def test_documents(spark):
    points = spark.createDataFrame([(1, "goal"), (1, "goal"), (1, "corner"), (2, "corner")], "frame_id long, type string")
    doc = R.landmark_document(points, points.filter("frame_id = 1 AND type = 'goal'")).first()
    assert doc.total_frames == 2 and doc.landmarks_detected.mean == 2.0 and doc.landmarks_detected.std == 1.0
    assert (doc.landmarks_selected.min, doc.landmarks_selected.max) == (0, 2)
    assert doc.by_type_average["goal"].asDict() == {"mean": 2.0, "median": 2.0, "min": 2, "max": 2, "total": 2}
    assert doc.by_type_average["corner"].total == 2
    summary = R.summary_document(points, True).first()
    assert summary.total_frames == 2 and summary.team_clusterer_trained and summary.pitch_dimensions.width == 68.0
    frames = R.frame_documents(spark.createDataFrame([(1, 0.5, 7, -1, 1.0, 2.0), (1, 0.5, 3, 0, 1.5, 2.5)], "frame_id long, timestamp double, object_id long, team_id long, x_pitch double, y_pitch double"))
    assert [p.object_id for p in frames.first().players] == [3, 7] and frames.first().num_players == 2
    images = spark.createDataFrame([(0, 2, "b.jpg"), (0, 1, "a.jpg")], "source int, id long, file_name string")
    boxes = spark.createDataFrame([(0, 1, 2)], "source int, id long, image_id long")
    coco = R.coco_document(images, boxes, spark.createDataFrame([(0, 1, "player")], "source int, id long, name string")).first()
    assert [i.file_name for i in coco.images] == ["a.jpg", "b.jpg"] and coco.annotations[0].image_id == 2 and coco.categories[0].name == "player"


def test_track_numbers(spark):
    from fieldglass.functions import labels as L

    got = spark.createDataFrame([("pass_7",), ("pass_7",), ("shot_9",)], "id string").select(L.track_number(F.col("id")).alias("n")).collect()
    assert got[0].n == got[1].n != got[2].n and all(0 <= r.n < 1_000_000 for r in got)
