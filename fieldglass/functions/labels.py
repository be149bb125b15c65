"""Label encodings, identifiers, formats and small lookups as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How reliable a landmark type's y coordinate is; other types 0.5.
Y_RELIABILITY = {
    "goal": 0.95,
    "center_line": 0.90,
    "penalty_box": 0.75,
    "goal_area": 0.70,
    "center_circle": 0.65,
    "penalty_spot": 0.60,
    "corner": 0.50,
    "corner_arc": 0.45,
    "touchline": 0.40
}
#: A landmark type's rank for calibration; other types 99.
PRIORITY = {
    "goal": 1,
    "touchline": 2,
    "center_line": 3,
    "center_circle": 4,
    "penalty_box": 5,
    "penalty_spot": 5,
    "goal_area": 5,
    "corner": 6,
    "corner_arc": 7
}


def coco_category(label: Column) -> Column:
    """2 for ball in any case, else 1."""
    return F.when(F.lower(label) == "ball", 2).otherwise(1)


def class_of(name: Column) -> Column:
    """0 for players and referees, 1 for the ball, else 0."""
    return F.when(F.lower(name) == "ball", 1).otherwise(0)


def decode_model_label(label: Column, classes: int = 2) -> Column:
    """Labels from 1 (0: background) to classes from 0; background, padding and unknown ones are null."""
    return F.when(label.between(1, classes), label - 1)


def class_name(category: Column, person: int = 0, ball: int = 37) -> Column:
    return F.when(category == person, "player").when(category == ball, "ball")


def event_confidence(kind: Column, speed: Column) -> Column:
    """Passes and shots by speed, dribbles and recoveries constant."""
    one = F.lit(1.0)
    return F.when(
        kind == "pass",
        F.least(one, speed / 20)
    ).when(kind == "shot", F.least(one, speed / 25)).when(kind == "dribble", F.lit(0.7)).when(kind == "recovery", F.lit(0.8))


def csv_confidence(confidence: Column) -> Column:
    """Null and 0 count as 1."""
    return F.when(confidence.isNull() | (confidence == 0), F.lit(1.0)).otherwise(confidence)


def csv_event_type(kind: Column) -> Column:
    return F.when(kind.isNull() | (kind == ""), "movement").otherwise(kind)


def frame_name(frame: Column) -> Column:
    return F.format_string("frame_%06d.jpg", frame)


def stem(path: Column) -> Column:
    """File name without folders and last suffix."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def annotations_name(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(mp4|avi|mov|mkv)$", "_annotations.xml")


def _lookup(values: dict, key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), key), other)


def y_reliability(kind: Column, confidence: Column, x: Column, y: Column, width: float, height: float) -> Column:
    """A type's reliability, up to 30 % less towards the image's corners, a tenth of the confidence more, at most 1."""
    dx, dy = x - width / 2, y - height / 2
    edge = F.sqrt(dx * dx + dy * dy) / ((width**2 + height**2) ** 0.5 / 2)
    return F.least(F.lit(1.0), _lookup(Y_RELIABILITY, kind, F.lit(0.5)) * (1.0 - edge * 0.3) + confidence * 0.1)


def priority(kind: Column) -> Column:
    return _lookup(PRIORITY, kind, F.lit(99))


def track_number(event_id: Column) -> Column:
    """A number below a million for an event's id, the same in every process."""
    return F.pmod(F.xxhash64(event_id), F.lit(1_000_000))
