"""Annotation datasets: merge, remap, split, sample, mosaic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import suppress_overlaps
from .matching import without_overlap


def dense_ids(df: DataFrame, order: list[str], out: str, first: int = 1, width: int = 100_000) -> DataFrame:
    """df with running numbers in a fixed order; rows are counted in hash-free ranges of the first order column.

    For a numeric first column only; the table of counts has a row for each ``width`` of its range.
    """
    b = F.floor(F.col(order[0]) / width)
    cut = df.withColumn("_b", b)
    n = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    n = n.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_at"))
    at = cut.withColumn("_i", F.row_number().over(W.partitionBy("_b").orderBy(*order)))
    return at.join(n, "_b").select(*df.columns, (F.col("_i") + F.col("_at") + (first - 1)).cast("long").alias(out))


def _shuffled(key: str, seed: int) -> Column:
    """A number from 0 to 2 ** 32 - 1 that md5 makes of key and seed, the same in any engine."""
    named = F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary")
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long")


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with ``part``: train for the first rows by count in a shuffled order, else val; repeatable anywhere."""
    rows = dense_ids(df.withColumn("_h", _shuffled(key, seed)), ["_h", key], "_at", 1, 1 << 20)
    n = df.agg(F.floor(F.count(F.lit(1)) * share).alias("_train"))  # one row
    return rows.join(F.broadcast(n)).withColumn("part", F.when(F.col("_at") <= F.col("_train"), "train").otherwise("val")).select(*df.columns, "part")


def sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement, the first of a shuffled order, in the key's order."""
    return df.orderBy(_shuffled(key, seed), key).limit(k).orderBy(key)


def strided(df: DataFrame, keys: list[str], order: str, step: int) -> DataFrame:
    """Every step-th row of a group in order, from the first."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", n).filter((F.col("_n") - 1) % step == 0).drop("_n")


def evenly_spaced(total: Column, k: int) -> Column:
    """Array of up to k distinct positions below total, from 0, evenly spaced."""
    step = F.greatest(F.lit(1), F.floor((total - 1) / max(1, k - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.least(i * step, total - 1).cast("long")))


def merge(first: DataFrame, second: DataFrame, prefix: str = "second_") -> DataFrame:
    """Rows of two datasets under (source, image_id); file names of the second that clash get a prefix."""
    names = first.select("file_name").distinct().withColumn("_clash", F.lit(True))
    other = second.join(names, "file_name", "left").withColumn(
        "file_name",
        F.when(F.col("_clash"), F.concat(F.lit(prefix), "file_name")).otherwise(F.col("file_name"))
    ).drop("_clash")
    return first.withColumn("source", F.lit(0)).unionByName(other.withColumn("source", F.lit(1)))


def merge_tracks(manual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Boxes of both by track and frame; manual ones win; track ids are numbers on both sides."""
    m = manual.withColumn("track_id", F.col("track_id").cast("long")).withColumn("by", F.lit("manual"))
    p = predicted.withColumn("track_id", F.col("track_id").cast("long")).withColumn("by", F.lit("predicted"))
    return m.unionByName(p.join(m.select("track_id", "frame_id"), ["track_id", "frame_id"], "left_anti"))


def mosaic(boxes: DataFrame, width: float, height: float, out_w: float, out_h: float, margin: float = 0.0, least: float = 1.0) -> DataFrame:
    """Boxes (x, y, w, h) of images numbered by ``quadrant`` 0..3, scaled into a mosaic's quadrants; cut or small ones go."""
    sx, sy = out_w / 2 / width, out_h / 2 / height
    qx, qy = (F.col("quadrant") % 2) * (out_w / 2), F.floor(F.col("quadrant") / 2) * (out_h / 2)
    at = boxes.withColumns({"x": F.col("x") * sx + qx, "y": F.col("y") * sy + qy, "w": F.col("w") * sx, "h": F.col("h") * sy})
    inside = (F.col("x") >= margin) & (F.col("y") >= margin) & (
        F.col("x") + F.col("w") <= out_w - margin
    ) & (F.col("y") + F.col("h") <= out_h - margin)
    return at.filter(inside & (F.col("w") >= least) & (F.col("h") >= least))


def mirrored(boxes: DataFrame, width: float) -> DataFrame:
    """Horizontal flip of x, y, w, h boxes."""
    return boxes.withColumn("x", F.lit(width) - F.col("x") - F.col("w"))


def remapped(images: DataFrame, annotations: DataFrame, width: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """images(source, image_id, ...) and annotations(source, annotation_id, image_id, ...) of merged datasets under new ids.

    Images and annotations are numbered from 1 by source and old id; annotations follow their image; those without one go.
    """
    images, annotations = (
        df.withColumn("_o", F.col("source") * F.lit(2**40) + F.col(c)) for df, c in ((images, "image_id"), (annotations, "annotation_id"))
    )
    new = dense_ids(images, ["_o"], "new_id", 1, width)
    ids = new.select("source", "image_id", F.col("new_id").alias("new_image_id"))
    found = annotations.join(ids, ["source", "image_id"])
    return new.drop("_o"), dense_ids(found, ["_o"], "new_id", 1, width).drop("_o")


def sliced_predictions(pred: DataFrame, width: float, height: float, least: float = 0.5) -> DataFrame:
    """pred(frame_id, class_id, det_id, confidence, x, y, w, h, tile_x, tile_y) of tiles, as boxes of the whole image.

    Boxes are moved by their tile's offset and cut at the image; of overlapping ones of a class the surest stay.
    """
    cut = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))
    x1, y1 = cut(F.col("x") + F.col("tile_x"), width), cut(F.col("y") + F.col("tile_y"), height)
    x2, y2 = cut(F.col("x") + F.col("tile_x") + F.col("w"), width), cut(F.col("y") + F.col("tile_y") + F.col("h"), height)
    whole = pred.withColumns({"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1}).drop("tile_x", "tile_y")
    return suppress_overlaps(whole, ["frame_id", "class_id"], least)


def merged_tags(tracks: DataFrame, tags: DataFrame, keep_tags: bool = False) -> DataFrame:
    """Rows of a merged annotation file: its tracks, and the tags that were there before only if asked for."""
    rows = tracks.withColumn("kind", F.lit("track"))
    return rows.unionByName(tags.withColumn("kind", F.lit("tag")), allowMissingColumns=True) if keep_tags else rows


def first_results(results: DataFrame, frames: DataFrame, order: str) -> DataFrame:
    """frames, each with the first result of its frame_id in order; frames without one go."""
    first = results.groupBy("frame_id").agg(F.min_by(F.struct(*[c for c in results.columns if c != "frame_id"]), order).alias("result"))
    return frames.join(first, "frame_id")


def resized(boxes: DataFrame, width: float, height: float, new_width: float, new_height: float) -> DataFrame:
    """Boxes (x, y, w, h) of an image that gets another size."""
    sx, sy = new_width / width, new_height / height
    return boxes.withColumns({"x": F.col("x") * sx, "y": F.col("y") * sy, "w": F.col("w") * sx, "h": F.col("h") * sy})


def warped(boxes: DataFrame, matrix: list[list[float]], width: float, height: float) -> DataFrame:
    """Boxes around the corners of boxes (x, y, w, h) under an affine map (two rows of three), cut at the image; empty ones go."""
    x1, y1, x2, y2 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]

    def ends(row: list[float], most: float) -> tuple[Column, Column]:
        at = [x * row[0] + y * row[1] + row[2] for x, y in corners]
        cut = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))
        return cut(F.least(*at)), cut(F.greatest(*at))

    (left, right), (top, low) = ends(matrix[0], width), ends(matrix[1], height)
    out = boxes.withColumns({"x": left, "y": top, "w": right - left, "h": low - top})
    return out.filter((F.col("w") > 0) & (F.col("h") > 0))


def shear(degrees: float) -> list[list[float]]:
    """The affine map of a horizontal shear."""
    return [[1.0, math.tan(math.radians(degrees)), 0.0], [0.0, 1.0, 0.0]]


def mixed_up(boxes: DataFrame, partners: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """boxes(frame_id, ...) and, under each frame of partners(frame_id, other), the scaled boxes of the other frame."""
    other = boxes.withColumnRenamed("frame_id", "other").join(partners, "other").drop("other")
    other = other.withColumns({"x": F.col("x") * scale_x, "w": F.col("w") * scale_x, "y": F.col("y") * scale_y, "h": F.col("h") * scale_y})
    return boxes.join(partners.select("frame_id"), "frame_id", "left_semi").unionByName(other)


def pasted(boxes: DataFrame, patches: DataFrame, width: float, height: float, most: int = 3, least: float = 0.1) -> DataFrame:
    """boxes with the first ``most`` patches of each frame that lie in the image and overlap no box by an IoU over ``least``.

    patches(frame_id, det_id, class_id, x, y, w, h) are proposals in order of det_id.
    """
    inside = (F.col("x") + F.col("w") <= width) & (F.col("y") + F.col("h") <= height)
    free = without_overlap(patches.filter(inside), boxes, least)
    turn = F.row_number().over(W.partitionBy("frame_id").orderBy("det_id"))
    chosen = free.withColumn("_n", turn).filter(F.col("_n") <= most).drop("_n")
    columns = ["frame_id", "det_id", "class_id", "x", "y", "w", "h"]
    return boxes.select(*columns, F.lit(False).alias("pasted")).unionByName(chosen.select(*columns, F.lit(True).alias("pasted")))


def last_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last in order, as a later entry replaces an earlier one."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("_m"))
    return best.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in others])


def dataset_summary(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """images, annotations, categories and annotations_each of each source, and how many annotations each category has, as an array in id order."""
    n = F.count(F.lit(1))
    by_kind = annotations.groupBy("source", "category_id").agg(n.alias("n"))
    kinds = categories.select("source", F.col("id").alias("category_id"), "name").join(by_kind, ["source", "category_id"], "left")
    entry = F.struct("category_id", "name", F.coalesce("n", F.lit(0)).alias("n"))
    kinds = kinds.groupBy("source").agg(n.alias("categories"), F.array_sort(F.collect_list(entry)).alias("by_category"))
    sizes = images.groupBy("source").agg(n.alias("images"))
    marks = annotations.groupBy("source").agg(n.alias("annotations"))
    out = sizes.join(marks, "source", "left").join(kinds, "source", "left").withColumn("annotations", F.coalesce("annotations", F.lit(0)))
    return out.withColumn("annotations_each", F.col("annotations") / F.col("images"))


def pitch_extent(players: DataFrame, keys: list[str]) -> DataFrame:
    """x_min, x_max, y_min, y_max over all players(x_pitch, y_pitch or, where these are null, pitch_position)."""
    x, y = (F.coalesce(F.col(c), F.get("pitch_position", F.lit(i))) for i, c in enumerate(("x_pitch", "y_pitch")))
    return players.groupBy(*keys).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))
