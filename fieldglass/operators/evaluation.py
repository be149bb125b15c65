"""Scores of predictions against targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import matching


def best_scored(pred: DataFrame, most: int = 100) -> DataFrame:
    """The ``most`` predictions of each image with the highest scores; ties go to the later one."""
    w = W.partitionBy("frame_id").orderBy(F.col("confidence").desc(), F.col("det_id").desc())
    return pred.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")


def sides(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Predictions and targets as one table: ``side`` is 0 for predictions and 1 for targets, whose confidence is null."""
    cols = ["frame_id", "class_id", "det_id", "x", "y", "w", "h"]
    none = F.lit(None).cast(pred.schema["confidence"].dataType)
    p = pred.select(*cols, "confidence", F.lit(0).alias("side"))
    return p.unionByName(gt.select(*cols, none.alias("confidence"), F.lit(1).alias("side")))


def evaluate(pred: DataFrame, gt: DataFrame, ious: tuple[float, ...] = (0.5, 0.75), strict: bool = False, most: int = 100) -> DataFrame:
    """true positives, predictions, targets, precision, recall, F1 and their product for each class and IoU.

    Of an image's predictions the ``most`` best scored count. Only images with both predictions and targets count;
    strict counts all. All levels are matched in one walk over the candidates.
    """
    return evaluate_sides(sides(pred, gt), ious, strict, most)


def evaluate_sides(boxes: DataFrame, ious: tuple[float, ...] = (0.5, 0.75), strict: bool = False, most: int = 100) -> DataFrame:
    """evaluate for one table with ``side`` (see sides). Boxes are dealt by frame once; counts and matches are taken there, nothing is joined."""
    frame = W.partitionBy("frame_id")
    best = F.row_number().over(frame.orderBy("side", F.col("confidence").desc(), F.col("det_id").desc()))
    boxes = boxes if strict else boxes.filter(F.col("frame_id").isNotNull())
    boxes = boxes.withColumn("_rank", best).filter((F.col("side") == 1) | (F.col("_rank") <= most))
    if not strict:
        boxes = boxes.withColumn("_both", F.min("side").over(frame) < F.max("side").over(frame)).filter("_both")
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("det_id", "confidence", "x", "y", "w", "h")))
    groups = boxes.groupBy("frame_id", "class_id").agg(of(0).alias("p"), of(1).alias("g"))
    known = F.col("frame_id").isNotNull() & F.col("class_id").isNotNull()  # a null is no one's image or class
    candidates = F.when(known, matching.candidates_within("p", "g", min(ious)))
    groups = groups.select("class_id", F.size("p").alias("predictions"), F.size("g").alias("targets"), candidates.alias("candidates"))
    tp = [F.coalesce(F.sum(matching.greedy_number("candidates", x)), F.lit(0)) for x in ious]
    total = groups.groupBy("class_id").agg(F.sum("predictions").alias("predictions"), F.sum("targets").alias("targets"), F.array(*tp).alias("tp"))
    levels = F.inline(F.arrays_zip(F.array(*[F.lit(float(x)) for x in ious]).alias("iou"), "tp"))
    at = total.select("class_id", levels, "predictions", "targets")
    at = at.withColumns({"precision": G.ratio("tp", "predictions"), "recall": G.ratio("tp", "targets")})
    return at.withColumns({"f1": G.f1("precision", "recall"), "product": F.col("precision") * F.col("recall")})


def greedy_counts(pred: DataFrame, gt: DataFrame, least: float = 0.5, distance: bool = True) -> DataFrame:
    """tp, fp, fn, recall, precision of all images by greedy matches, and the mean distance of centres assigned by distance.

    Images without targets count their predictions as false, those without predictions their targets as missed. Without
    ``distance`` nothing is assigned and the mean distance is null.
    """
    tp = matching.greedy_matches(matching.candidate_matches(pred, gt, least)).agg(F.count(F.lit(1)).alias("tp"))
    if distance:
        way = matching.optimal_matches(pred, gt, by="distance").agg(F.avg("distance").alias("mean_distance"))
    else:
        way = pred.sparkSession.range(1).select(F.lit(None).cast("double").alias("mean_distance"))
    n = pred.agg(F.count(F.lit(1)).alias("p")).join(gt.agg(F.count(F.lit(1)).alias("g")))  # one row each
    out = tp.join(n).join(way).select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), "mean_distance")
    return out.withColumns({"recall": G.ratio("tp", F.col("tp") + F.col("fn")), "precision": G.ratio("tp", F.col("tp") + F.col("fp"))})


def ball_counts(pred: DataFrame, gt: DataFrame, least: float = 0.5, compat: bool = False) -> DataFrame:
    """tp, fp, fn of optimal assignments; compat counts an assigned pair under the IoU as a false positive twice."""
    m = matching.optimal_matches(pred, gt).agg(
        F.count_if(F.col("iou") >= least).alias("tp"),
        F.count_if(F.col("iou") < least).alias("weak"),
        F.avg("distance").alias("mean_distance")
    )
    n = pred.agg(F.count(F.lit(1)).alias("p")).join(gt.agg(F.count(F.lit(1)).alias("g")))  # one row each
    fp = F.col("p") - F.col("tp") + (F.col("weak") if compat else F.lit(0))
    return m.join(n).select("tp", fp.alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), "mean_distance")
