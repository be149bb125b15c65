"""Readers of results, logs and listings, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "struct<x:double,y:double>"
EVENTS = f"match_id string, events array<struct<id:string,type:string,start_frame:bigint,end_frame:bigint,start_location:{PLACE},end_location:{PLACE},involved_players:array<bigint>,confidence:double,timestamp_start:double,timestamp_end:double>>, metadata struct<total_frames:bigint>"
FRAME_DATA = "frame_id bigint, timestamp double, players array<struct<object_id:bigint,team_id:int,x_pitch:double,y_pitch:double,pitch_position:array<double>,bbox:array<double>>>, num_players int"
PREDICTIONS = "frame bigint, detections array<struct<class_id:int,confidence:double,bbox:array<double>>>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None and len(
        p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    ) > 0


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """match_id and the events' fields; a missing file has none."""
    doc = spark.read.schema(EVENTS).option("multiLine", True).json(path) if _exists(spark, path) else spark.createDataFrame([], EVENTS)
    return doc.select("match_id", F.explode("events").alias("e")).select("match_id", "e.*")


def read_frame_data(spark: SparkSession, path: str) -> DataFrame:
    """A row for each player of each frame, frames without players once; positions by either field name."""
    at = spark.read.schema(FRAME_DATA).option("multiLine", True).json(path).select("frame_id", "timestamp", F.explode_outer("players").alias("p"))
    x = F.coalesce("p.x_pitch", F.get("p.pitch_position", F.lit(0)))
    y = F.coalesce("p.y_pitch", F.get("p.pitch_position", F.lit(1)))
    return at.select("frame_id", "timestamp", "p.object_id", "p.team_id", x.alias("x_pitch"), y.alias("y_pitch"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    at = spark.read.schema(PREDICTIONS).option("multiLine", True).json(path).select(
        F.col("frame").alias("frame_id"),
        F.posexplode("detections").alias("det_id", "p")
    )
    return at.select("frame_id", "det_id", "p.class_id", "p.confidence", *[F.get("p.bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")])


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with epoch and numbers; lines that aren't JSON are skipped."""
    return spark.read.schema("epoch int, loss double, map double").option("mode", "DROPMALFORMED").json(path).filter("epoch IS NOT NULL")


def latest_epoch(log: DataFrame) -> DataFrame:
    return log.agg(F.max("epoch").alias("epoch"))


def read_text_log(spark: SparkSession, path: str, pattern: str = r"Epoch (\d+).*?loss[:=] ?([0-9.]+)") -> DataFrame:
    """epoch, loss from free text."""
    at = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(f"(?s){pattern}"), F.lit(0))).alias("m"))
    return at.select(
        F.regexp_extract("m", f"(?s){pattern}", 1).cast("int").alias("epoch"),
        F.regexp_extract("m", f"(?s){pattern}", 2).cast("double").alias("loss")
    )


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png"), prefix: str = "") -> DataFrame:
    """path and size of files by suffix in any case and name prefix, in name order."""
    from ..functions import labels as L

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    ok = F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$") & L.stem(F.col("path")).startswith(prefix)
    return files.filter(ok).orderBy("path")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """One row: homography as nine numbers, y_axis_scale (1 where missing)."""
    doc = spark.read.schema("homography array<array<double>>, y_axis_scale double").option("multiLine", True).json(path)
    return doc.select(F.flatten("homography").alias("homography"), F.coalesce("y_axis_scale", F.lit(1.0)).alias("y_scale"))


def write_frame_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def events_document(events: DataFrame) -> DataFrame:
    """A row for each match: its events in order and how many frames have any."""
    one = F.struct(
        F.col("start_frame"),
        "id",
        "type",
        "end_frame",
        "start_location",
        "end_location",
        F.array("player").alias("involved_players"),
        "confidence",
        F.col("ts_start").alias("timestamp_start"),
        F.col("ts_end").alias("timestamp_end")
    )
    return events.groupBy(F.col("match_id").cast("string").alias("match_id")).agg(
        F.array_sort(F.collect_list(one)).alias("events"),
        F.struct(F.countDistinct("end_frame").alias("total_frames")).alias("metadata")
    )


def write_events(events: DataFrame, path: str) -> None:
    events_document(events).write.json(path)


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row for each source with its three arrays in id order."""
    def arr(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c not in ("source", "id")]
        return df.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("id", *cols))).alias(name))

    return arr(images, "images").join(arr(annotations, "annotations"), "source", "left").join(arr(categories, "categories"), "source", "left")


def cvat_tracks(boxes: DataFrame) -> DataFrame:
    """A row for each (match, object, label): its XML element's fields, boxes by frame, coordinates with two decimals."""
    from pyspark.sql import Window as W

    two = lambda c: F.format_string("%.2f", c)
    b = F.struct(
        "frame_id",
        two(F.col("x")).alias("xtl"),
        two(F.col("y")).alias("ytl"),
        two(F.col("x") + F.col("w")).alias("xbr"),
        two(F.col("y") + F.col("h")).alias("ybr"),
        F.format_string("%.3f", "confidence").alias("confidence")
    )
    t = boxes.groupBy("match_id", "object_id", "label").agg(F.array_sort(F.collect_list(b)).alias("boxes"))
    return t.withColumn("id", F.row_number().over(W.partitionBy("match_id").orderBy("object_id", "label")) - 1)


def write_cvat(boxes: DataFrame, path: str) -> None:
    """Tracks as XML files, one root per part."""
    t = cvat_tracks(boxes).select(
        F.col("id").alias("_id"),
        F.col("label").alias("_label"),
        F.transform(
            "boxes",
            lambda b: F.struct(
                b["frame_id"].alias("_frame"),
                b["xtl"].alias("_xtl"),
                b["ytl"].alias("_ytl"),
                b["xbr"].alias("_xbr"),
                b["ybr"].alias("_ybr"),
                F.lit(0).alias("_outside"),
                F.array(F.struct(F.lit("confidence").alias("_name"), b["confidence"].alias("_VALUE"))).alias("attribute")
            )
        ).alias("box")
    )
    t.write.format("xml").option("rootTag", "annotations").option("rowTag", "track").save(path)


def frame_documents(rows: DataFrame) -> DataFrame:
    """rows(frame_id, timestamp, object_id, team_id, x_pitch, y_pitch) as a document for each frame."""
    p = F.struct("object_id", "team_id", "x_pitch", "y_pitch")
    return rows.groupBy("frame_id", "timestamp").agg(F.array_sort(F.collect_list(p)).alias("players")).withColumn("num_players", F.size("players"))


def write_event_tags(events: DataFrame, path: str, source: str = "auto") -> None:
    """Events as tags of an annotation file, at their first frame, with confidence and players as attributes."""
    named = lambda name, value: F.struct(F.lit(name).alias("_name"), value.alias("_VALUE"))
    players = F.when(F.col("player").isNotNull(), F.array(named("involved_players", F.col("player").cast("string"))))
    confidence = F.array(named("confidence", F.format_string("%.3f", "confidence")))
    tags = events.select(
        F.col("type").alias("_label"),
        F.col("start_frame").alias("_frame"),
        F.lit(source).alias("_source"),
        F.concat(confidence, F.coalesce(players, F.expr("cast(array() as array<struct<_name string, _VALUE string>>)"))).alias("attribute")
    )
    tags.write.format("xml").option("rootTag", "annotations").option("rowTag", "tag").save(path)


def read_event_tags(spark: SparkSession, path: str) -> DataFrame:
    """label, frame_id, source, confidence (null where it is no number) and players (as text) of an annotation file's tags."""
    schema = "_label string, _frame long, _source string, attribute array<struct<_VALUE string, _name string>>"
    tags = spark.read.format("xml").option("rowTag", "tag").schema(schema).load(path)
    return tags.select(
        F.col("_label").alias("label"),
        F.col("_frame").alias("frame_id"),
        F.col("_source").alias("source"),
        F.expr("try_cast(try_element_at(filter(attribute, a -> a._name = 'confidence'), 1)._VALUE AS double)").alias("confidence"),
        F.expr("try_element_at(filter(attribute, a -> a._name = 'involved_players'), 1)._VALUE").alias("players")
    )


def summary_document(frames: DataFrame, teams_known: bool, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """One row: how many frames there are, whether teams were told apart, and the pitch's size."""
    pitch = F.struct(F.lit(length).alias("length"), F.lit(width).alias("width")).alias("pitch_dimensions")
    return frames.agg(F.countDistinct("frame_id").alias("total_frames")).select("total_frames", F.lit(teams_known).alias("team_clusterer_trained"), pitch)


def landmark_document(keypoints: DataFrame, selected: DataFrame) -> DataFrame:
    """One row of statistics of keypoints(frame_id, type) and of those selected: over frames, and over frames by type."""
    def spread(df: DataFrame, n: str, *more) -> DataFrame:
        return df.agg(F.avg(n).alias("mean"), F.median(n).alias("median"), F.min(n).alias("min"), F.max(n).alias("max"), *more)

    size = F.count(F.lit(1))
    frames = keypoints.groupBy("frame_id").agg(size.alias("found")).join(selected.groupBy("frame_id").agg(size.alias("taken")), "frame_id", "left")
    frames = frames.withColumn("taken", F.coalesce("taken", F.lit(0)))
    types = spread(keypoints.groupBy("type", "frame_id").agg(size.alias("n")).groupBy("type"), "n", F.sum("n").alias("total"))
    by_type = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.struct("mean", "median", "min", "max", "total")))))
    one = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    whole = frames.agg(size.alias("total_frames"))
    for n, name in (("found", "landmarks_detected"), ("taken", "landmarks_selected")):
        whole = whole.join(one(spread(frames.groupBy(), n, F.stddev_pop(n).alias("std")), name))  # one row each
    return whole.join(types.agg(by_type.alias("by_type_average")))
