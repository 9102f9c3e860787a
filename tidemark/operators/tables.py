"""Tables that jobs share: written once, so that what is derived from them agrees."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_own: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration in the folder all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if named is None and not _own:
            _own.append(tempfile.mkdtemp(prefix="tidemark-"))
        context.setCheckpointDir(f"{named or 'file://' + _own[0]}/{uuid.uuid4().hex}")
    return df.checkpoint()


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """0-based rank over all rows.

    Rows are range-partitioned by the order, sorted and numbered within their partitions, and
    written once: the partition's number and the place in it are read back from one id, so that
    rows and counts come from the same ranges. Only one count a partition is summed up.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # One row a partition, whatever the number of rows.
    shifts = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = placed.withColumn("__part", part).join(F.broadcast(shifts), "__part")
    return ranked.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__before")


def running_sum(df: DataFrame, at: str, value: str, name: str, width: int = 1 << 16) -> DataFrame:
    """df with the sum of `value` up to each row, by its 0-based place `at`, which is unique.

    Places are cut into ranges of `width`, each summed in one task; one row a range meets in one place.
    """
    cut = saved(df.withColumn("__range", F.floor(F.col(at) / width)))
    sums = cut.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return cut.join(before, "__range").withColumn(name, F.col("__before") + within).drop("__range", "__before")


def children(spark, path: str) -> list[str]:
    """The names in a folder of any store that Spark reaches; none where there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
