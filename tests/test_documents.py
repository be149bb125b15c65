"""One document for each match: round trips, and nothing left of a failed write."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fieldglass.sources import annotations as A
from fieldglass.sources import documents as D
from fieldglass.sources import results as R


def test_cvat_documents(spark, tmp_path):
    rows = [(m, o, "player" if o else 'b<a>"ll', f, 1.0 + f, 2.0, 3.0, 4.0, 0.5) for m in range(5) for o in range(3) for f in range(20)]
    boxes = spark.createDataFrame(rows, "match_id long, object_id long, label string, frame_id long, x double, y double, w double, h double, confidence double")
    events = spark.createDataFrame([(m, "pass", 3 + m, 7, 0.25) for m in range(5)] + [(2, "shot", 1, None, 1.0)], "match_id long, type string, start_frame long, player long, confidence double")
    meta = spark.createDataFrame([(m, k, f"{k} & {m}") for m in range(5) for k in ("match_id", "venue")], "match_id long, key string, value string")
    out = str(tmp_path / "cvat")
    D.write_cvat_documents(boxes.repartition(7), events, meta, out)
    assert sorted(os.listdir(out)) == [f"{m}.xml" for m in range(5)]
    assert A.read_cvat(spark, out).count() == len(rows)
    one = A.read_cvat(spark, f"{out}/2.xml")
    assert one.count() == 60 and one.filter(F.col("label") == 'b<a>"ll').count() == 20
    tags = sorted(map(tuple, R.read_event_tags(spark, f"{out}/2.xml").collect()))
    assert tags == [("pass", 5, "auto", 0.25, "7"), ("shot", 1, "auto", 1.0, None)]
    assert {(r.key, r.value) for r in D.read_meta(spark, f"{out}/2.xml").collect()} == {("match_id", "match_id & 2"), ("venue", "venue & 2")}


def test_coco_documents(spark, tmp_path):
    images = spark.createDataFrame([(s, i, f"{i}.jpg", 10, 10) for s in (0, 1) for i in range(40)], "source int, id long, file_name string, width int, height int")
    marks = spark.createDataFrame([(0, i, i % 40, 1, [1.0, 2.0, 3.0, 4.0], 12.0, 0) for i in range(100)], "source int, id long, image_id long, category_id int, bbox array<double>, area double, iscrowd int")
    kinds = spark.createDataFrame([(s, 1, "player") for s in (0, 1)], "source int, id long, name string")
    out = str(tmp_path / "coco")
    D.write_coco_documents(images, marks, kinds, out)
    first, second = (json.load(open(f"{out}/{s}.json")) for s in (0, 1))
    assert [i["id"] for i in first["images"]] == list(range(40)) and len(first["annotations"]) == 100
    assert second["annotations"] == [] and second["categories"] == [{"id": 1, "name": "player"}]
    i, a, c = A.read_coco(spark, f"{out}/0.json")
    assert (i.count(), a.count(), c.count()) == (40, 100, 1)


def test_failed_write_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "docs")
    os.makedirs(out)
    rows = spark.range(1000).select((F.col("id") % 9).cast("string").alias("name"), F.col("id").alias("n"))
    broken = F.when(F.col("n") == 777, F.raise_error(F.lit("broken"))).otherwise(F.col("n").cast("string"))
    with pytest.raises(Exception, match="broken"):
        D.write_documents(rows.select("name", "n", broken.alias("piece")), out, ["n"])
    assert os.listdir(out) == []
    D.write_documents(rows.select("name", "n", F.col("n").cast("string").alias("piece")), out, ["n"], header="<", footer=">", separator=" ")
    assert open(f"{out}/4.txt").read() == "<" + " ".join(str(i) for i in range(1000) if i % 9 == 4) + ">"
    assert len(os.listdir(out)) == 9


def test_split_coco_equals_the_whole(spark, tmp_path):
    import random

    from fieldglass.sources import split_json as S

    rnd = random.Random(4)
    odd = ['a{b', '[x]', 'q"q', "back\\slash", "end\\", "é ß", '\\"', "]}]}", "\\\\"]
    for k, indent in ((0, None), (1, 2)):
        doc = {
            "info": {"description": "{[", "version": {"a": 1}},
            "images": [{"id": i, "file_name": f"{rnd.choice(odd)}{i}.jpg", "width": 4, "height": 5} for i in range(150)],
            "annotations": [
                {"id": i, "image_id": i % 150, "category_id": 1, "bbox": [1.0, 2.0, 3.0, float(i)], "area": 2.0, "iscrowd": 0, "extra": {"deep": [{"x": rnd.choice(odd)}]}} for i in range(400)
            ],
            "licenses": [{"id": 1, "name": "free", "url": "u"}],
            "categories": [{"id": 1, "name": "player", "supercategory": "x{"}, {"id": 2, "name": rnd.choice(odd)}],
        }
        (tmp_path / "coco").mkdir(exist_ok=True)
        (tmp_path / "coco" / f"{k}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(k)))
    (tmp_path / "coco" / "empty.json").write_text("{}")
    path = str(tmp_path / "coco")
    want = [sorted(map(repr, df.collect())) for df in A.read_coco(spark, path)]
    for chunk in (37, 1000, 1 << 20):
        got = [sorted(map(repr, df.collect())) for df in S.read_coco_split(spark, path, chunk)]
        assert got == want, chunk
    assert [len(x) for x in want] == [300, 800, 4]
