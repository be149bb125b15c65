"""COCO files read by many tasks: byte ranges whose place in the JSON's structure is worked out exactly.

Whether a byte stands within a string, and how deep, depends on all bytes before it. So each range is scanned first and
tells how many quotes it has and how the depth changes over it, for both cases of its beginning (inside or outside of a
string); the ranges before one then give its beginning: a table with a row for each range. In a second scan each range
gives the elements that begin in it, reading on to the end of the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import written

ELEMENT = (
    "id bigint, file_name string, width int, height int, image_id bigint, category_id int, bbox array<double>, area double, "
    "iscrowd int, name string, supercategory string, url string"
)


def _opened(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def _backslashes(f, start: int) -> int:
    """How many backslashes stand right before a place."""
    n = 0
    while start - n > 0:
        lo = max(0, start - n - 4096)
        f.seek(lo)
        piece = f.read(start - n - lo)
        run = len(piece) - len(piece.rstrip(b"\\"))
        n += run
        if run < len(piece):
            break
    return n


def structure(data: bytes, before: int, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it is a bracket outside of strings (1 opens, -1 closes, else 0); and where unescaped quotes are.

    before: backslashes right before the data; inside: the data begins within a string.
    """
    b = np.frombuffer(data, np.uint8)
    i = np.arange(len(b))
    last = np.maximum.accumulate(np.where(b != 92, i, -1 - before))
    run = i - 1 - np.concatenate([[-1 - before], last[:-1]])  # backslashes right before each byte
    quote = (b == 34) & (run % 2 == 0)
    outside = (np.cumsum(quote) + inside) % 2 == 0
    step = np.where((b == 123) | (b == 91), 1, np.where((b == 125) | (b == 93), -1, 0))
    return np.where(outside, step, 0), quote


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, n, start, end in zip(pdf["path"], pdf["n"], pdf["start"], pdf["end"], strict=True):
            with _opened(path) as f:
                before = _backslashes(f, start)
                f.seek(start)
                data = f.read(end - start)
            plain, quote = structure(data, before, False)
            within, _ = structure(data, before, True)
            out.append((path, n, start, end, int(quote.sum()) % 2, int(plain.sum()), int(within.sum())))
        yield pd.DataFrame(out, columns=["path", "n", "start", "end", "odd", "plain", "within"])


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, start, end, inside, depth in zip(pdf["path"], pdf["start"], pdf["end"], pdf["inside"], pdf["depth"], strict=True):
            with _opened(path) as f:
                before, size = _backslashes(f, start), f.size()
                more = 0
                while True:
                    f.seek(start)
                    data = f.read(end + more - start)
                    step, _ = structure(data, before, bool(inside))
                    after = depth + np.cumsum(step)
                    first = np.flatnonzero((step[: end - start] == 1) & (after[: end - start] == 3) & (np.frombuffer(data, np.uint8)[: end - start] == 123))
                    last = np.flatnonzero((step == -1) & (after == 2))
                    at = np.searchsorted(last, first)
                    if not len(at) or at[-1] < len(last) or end + more >= size:
                        break
                    more = max(1 << 16, 2 * more)
            texts = [data[a : last[k] + 1].decode() for a, k in zip(first.tolist(), at.tolist(), strict=True) if k < len(last)]
            yield pd.DataFrame({"element": pd.Series(texts, dtype=object)})


def json_elements(spark: SparkSession, path: str, chunk: int = 16 << 20) -> DataFrame:
    """The objects in the arrays of files of one JSON object each, as text (element); each range of ``chunk`` bytes is a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / chunk)).cast("int"))
    ranges = files.filter("length > 0").select("path", "length", F.explode(numbers).alias("n"))
    start = F.col("n").cast("long") * chunk
    ranges = ranges.select("path", "n", start.alias("start"), F.least(start + chunk, F.col("length")).alias("end"))
    kinds = "path string, n int, start long, end long"
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    told = ranges.repartition(tasks, "path", "n").mapInPandas(_scan, f"{kinds}, odd int, plain long, within long")
    before = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    placed = written(told, "ranges").withColumn("inside", inside)
    change = F.when(F.col("inside") == 1, F.col("within")).otherwise(F.col("plain"))
    placed = placed.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    placed = placed.select("path", "n", "start", "end", "inside", "depth")
    return placed.repartition(tasks, "path", "n").mapInPandas(_elements, "element string")


def read_coco_split(spark: SparkSession, path: str, chunk: int = 16 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As annotations.read_coco, but a large file is many tasks. What an element is follows from its fields."""
    rows = written(json_elements(spark, path, chunk), "elements").select(F.from_json("element", ELEMENT).alias("r")).select("r.*")
    box = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")]
    images = rows.filter("file_name IS NOT NULL").select("id", "file_name", "width", "height")
    marks = rows.filter("image_id IS NOT NULL").select("id", "image_id", "category_id", *box, "area", "iscrowd")
    kinds = rows.filter("name IS NOT NULL AND file_name IS NULL AND image_id IS NULL AND url IS NULL")
    return images, marks, kinds.select(F.col("id").cast("int").alias("id"), "name", "supercategory")
