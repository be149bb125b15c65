"""Shared pieces: tables in the shared checkpoint folder, ranks and running sums in two levels."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters between words, as a character class: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(own := tempfile.mkdtemp(prefix="fieldglass-"))
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return sc.getCheckpointDir()


class Scratch:
    """Tables of one run in the shared folder. Writing one cuts the lineage, and survives the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
        """Write df and return what reads it back."""
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_bucketed(self, df: DataFrame, name: str, key: str, codec: str = "zstd") -> DataFrame:
        """As save, in one bucket of ``key`` for each shuffle partition, so that later joins on key don't shuffle it again."""
        path, table = self.path(name), f"fieldglass_{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("compression", codec).option("path", path).bucketBy(buckets, key).saveAsTable(table)
        return self.spark.table(table)

    def settle(self) -> None:
        """Let Spark delete shuffle files of finished steps now; else they stay until the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            p.getFileSystem(conf).delete(p, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also when body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def ranked(df: DataFrame, keys: list[str], ids: list[str], out: str, n_buckets: int = 256, value: str | None = None) -> DataFrame:
    """df with ``out``: rows (or the sum of ``value``) before this one among the rows of the same keys.

    The order is by a hash bucket of ``ids``, then ``ids``: any fixed order without gaps. Rows are ranked within
    (keys, bucket) and shifted by the bucket's offset, so that a key with most of the rows is still dealt to
    n_buckets tasks, or as many as there are shuffle partitions if that is more; the table of offsets has a row for each
    of them and key. df is read twice: pass a saved table.
    """
    b = "_bucket"
    n_buckets = max(n_buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    amount = F.col(value).cast("long") if value else F.lit(1).cast("long")
    parted = df.withColumn(b, F.pmod(F.xxhash64(*ids), F.lit(n_buckets)).cast("int"))
    size = parted.groupBy(*keys, b).agg(F.sum(amount).alias("_size"))
    before = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offset = size.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    within = W.partitionBy(*keys, b).orderBy(*ids).rowsBetween(W.unboundedPreceding, -1)
    mine = parted.withColumn("_mine", F.coalesce(F.sum(amount).over(within), F.lit(0).cast("long")))
    cond = [mine[k].eqNullSafe(offset[k]) for k in [*keys, b]]
    joined = mine.join(offset, cond)
    return joined.select(*[mine[c] for c in df.columns], (F.col("_mine") + F.col("_offset")).alias(out))


def ordered_prefix(df: DataFrame, order: str, value: str, out: str, tmp: Scratch, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with ``out``: the sum of ``value`` over the rows that come before in the order of ``order``, then ``ties``.

    Rows are dealt to sampled ranges of that order (nulls first), of about equal numbers of rows however the values are
    spread; they are summed within their range and shifted by the sums of the ranges before, a table with a row for
    each shuffle partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, order, *ties).withColumn("_bucket", F.spark_partition_id())
    parted = tmp.save(parted, "ranges")
    size = parted.groupBy("_bucket").agg(F.sum(value).alias("_size"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = size.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = W.partitionBy("_bucket").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    mine = parted.withColumn("_mine", F.coalesce(F.sum(value).over(within), F.lit(0).cast("long")))
    return mine.join(F.broadcast(offset), "_bucket").select(*df.columns, (F.col("_mine") + F.col("_offset")).alias(out))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
