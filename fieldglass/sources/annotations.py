"""Readers of annotation files as DataFrames with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int>>, "
    "categories array<struct<id:int,name:string,supercategory:string>>"
)


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations (x, y, w, h flat) and categories of COCO files."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    rows = lambda c: doc.select(F.explode(c).alias("r")).select("r.*")
    box = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")]
    return rows("images"), rows("annotations").select("id", "image_id", "category_id", *box, "area", "iscrowd"), rows("categories")


def coco_targets(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """A row for each box of each image, images without boxes once; labels 1 for players, ball boxes dropped; corner boxes."""
    named = annotations.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    kept = named.filter(F.coalesce(F.lower("name") != "ball", F.lit(True)))
    boxes = kept.select(
        "image_id",
        F.lit(1).alias("label"),
        F.col("x").alias("x_min"),
        F.col("y").alias("y_min"),
        (F.col("x") + F.col("w")).alias("x_max"),
        (F.col("y") + F.col("h")).alias("y_max")
    )
    return images.select(F.col("id").alias("image_id"), "file_name").join(boxes, "image_id", "left")


def dataset_issues(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(issue, n) of structural faults: unknown images or categories, bad boxes, images listed twice."""
    def count(df: DataFrame, issue: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(issue).alias("issue"), "n")

    a = annotations
    found = [
        count(a.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti"), "unknown image"),
        count(a.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti"), "unknown category"),
        count(a.filter("w <= 0 OR h <= 0 OR x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL"), "bad box"),
        count(images.groupBy("id").count().filter("count > 1"), "repeated image"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter("n > 0")


def read_wide_csv(spark: SparkSession, path: str, ball: bool = True) -> DataFrame:
    """frame_id, team, player, x, y, w, h from CSVs with a team row, a player row and an attribute row.

    The first two lines of a file whose first cell is no number name the teams and players; lines with a number there
    are data. Each entity has four columns, height, left, top and width; blanks count as 0; an entity with a bad number
    or an all-zero box is skipped. Files are read by lines, a large one in several tasks.
    """
    cells = spark.read.text(path).select(
        F.input_file_name().alias("file"),
        F.input_file_block_start().alias("at"),
        F.monotonically_increasing_id().alias("line"),
        F.split("value", ",").alias("c")
    )
    frame = F.expr("try_cast(c[0] AS bigint)")
    place = F.row_number().over(W.partitionBy("file").orderBy("at", "line"))
    head = cells.filter(frame.isNull()).withColumn("n", place).filter("n <= 2").groupBy("file").agg(
        F.max(F.when(F.col("n") == 1, F.col("c"))).alias("teams"),
        F.max(F.when(F.col("n") == 2, F.col("c"))).alias("players")
    )
    data = cells.filter(frame.isNotNull() & (F.size("c") > 1)).join(head, "file")
    entity = data.select(
        "file",
        F.expr("try_cast(c[0] AS bigint)").alias("frame_id"),
        "c",
        "teams",
        "players",
        F.explode(F.sequence(F.lit(1), F.size("c") - 4, F.lit(4))).alias("i")
    )
    number = lambda k: F.expr(f"try_cast(CASE WHEN trim(get(c, i + {k})) = '' THEN '0' ELSE get(c, i + {k}) END AS double)")
    out = entity.select(
        "frame_id",
        F.expr("trim(get(teams, i))").alias("team"),
        F.expr("trim(get(players, i))").alias("player"),
        number(0).alias("h"),
        number(1).alias("x"),
        number(2).alias("y"),
        number(3).alias("w")
    )
    teams = ["0", "1", "BALL"] if ball else ["0", "1"]
    out = out.filter(F.col("team").isin(teams)).dropna(subset=["frame_id", "x", "y", "w", "h"]).filter("NOT (x = 0 AND y = 0 AND w = 0 AND h = 0)")
    return out.select("frame_id", "team", "player", "x", "y", "w", "h")


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """frame_id, player_id, x, y, w, h from lines frame,id,cx,cy,w,h,...; corners aren't negative; short lines are skipped."""
    c = F.split("value", ",")
    n = lambda i, t: F.expr(f"try_cast(get(c, {i}) AS {t})")
    at = spark.read.text(path).select(c.alias("c")).filter(F.size("c") >= 6)
    at = at.select(
        n(0, "bigint").alias("frame_id"),
        n(1, "bigint").alias("player_id"),
        n(2, "double").alias("cx"),
        n(3, "double").alias("cy"),
        n(4, "double").alias("w"),
        n(5, "double").alias("h")
    )
    return at.dropna().select(
        "frame_id",
        "player_id",
        F.greatest(F.lit(0.0), F.col("cx") - F.col("w") / 2).alias("x"),
        F.greatest(F.lit(0.0), F.col("cy") - F.col("h") / 2).alias("y"),
        "w",
        "h"
    )


def read_yolo(spark: SparkSession, path: str, images: DataFrame, least: float = 0.0) -> DataFrame:
    """stem, class_id, x, y, w, h in pixels; images(stem, width, height) gives sizes; files without an image are skipped."""
    from ..functions import geometry as G
    from ..functions import labels as L

    at = spark.read.text(path).select(L.stem(F.input_file_name()).alias("stem"), F.split(F.trim("value"), r"\s+").alias("c")).filter(F.size("c") == 5)
    n = lambda i: F.expr(f"try_cast(c[{i}] AS double)")
    at = at.select("stem", n(0).cast("int").alias("class_id"), *[n(i + 1).alias(k) for i, k in enumerate(("cx", "cy", "bw", "bh"))]).dropna()
    box = G.denormalize("cx", "cy", "bw", "bh", F.col("width"), F.col("height"))
    return at.join(images, "stem").select(
        "stem",
        "class_id",
        *[b.alias(k) for b, k in zip(box, "xywh", strict=True)]
    ).filter((F.col("w") > least) & (F.col("h") > least))


CVAT = "_id bigint, _label string, _source string, box array<struct<_frame:bigint,_xtl:double,_ytl:double,_xbr:double,_ybr:double,_outside:int,_occluded:int,_keyframe:int,attribute:array<struct<_name:string,_VALUE:string>>>>"


def read_cvat(spark: SparkSession, path: str, frame: int | None = None, with_first: bool = False) -> DataFrame:
    """track_id, label, frame_id, x, y, w, h, confidence of CVAT tracks.

    frame: only that frame. with_first: only tracks that have a box in frame 0. Confidence is 1 where it is missing or no number.
    """
    from ..functions import geometry as G

    tracks = spark.read.format("xml").option("rowTag", "track").schema(CVAT).load(path)
    conf = F.expr("try_cast(filter(b.attribute, a -> a._name = 'confidence')[0]._VALUE AS double)")
    at = tracks.select(F.col("_id").alias("track_id"), F.col("_label").alias("label"), F.explode("box").alias("b"))
    box = G.to_sizes("b._xtl", "b._ytl", "b._xbr", "b._ybr", clamp=True)
    at = at.select(
        "track_id",
        "label",
        F.col("b._frame").alias("frame_id"),
        *[v.alias(k) for v, k in zip(box, "xywh", strict=True)],
        F.coalesce(conf, F.lit(1.0)).alias("confidence")
    )
    if with_first:
        at = at.join(at.filter("frame_id = 0").select("track_id"), "track_id", "left_semi")
    return at.filter(F.col("frame_id") == frame) if frame is not None else at


VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def read_voc(spark: SparkSession, path: str, name: str = "ball") -> DataFrame:
    """filename, width, height, x, y, w, h of one kind of object; a path element that isn't closed is repaired."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"<path>([^<]*)<(?!/path>)[^>]*>", "<path>$1</path>").alias("v"))
    doc = raw.select(F.from_xml("v", VOC).alias("d")).select("d.*")
    at = doc.select("filename", "size.width", "size.height", F.explode("object").alias("o")).filter(F.col("o.name") == name)
    b = "o.bndbox."
    return at.select(
        "filename",
        "width",
        "height",
        F.col(b + "xmin").alias("x"),
        F.col(b + "ymin").alias("y"),
        (F.col(b + "xmax") - F.col(b + "xmin")).alias("w"),
        (F.col(b + "ymax") - F.col(b + "ymin")).alias("h")
    )
