"""What several corpus operators share: input tables, staged tables, prefix sums over hot groups."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One run of white space, as the near-duplicate and exact-duplicate contracts define it.
BLANKS = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []
#: The folders of staged tables.
_staged: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A temporary one only where it is unset and Spark runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return f"file://{_own_dir[0]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _staged[found] = path
    return found


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df lacks, in any case of letters: each as asked for, or with a number behind it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        found = next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)
        taken.add(found.lower())
        out.append(found)
    return out


def folder(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Spark has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def free(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more. What a result still reads stays in the shared folder."""
    for t in tables:
        if path := _staged.pop(t, None):
            fs, at = folder(t.sparkSession, path)
            fs.delete(at, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner remove shuffle files that nothing reads any more.

    It learns of them when the driver's JVM collects garbage, by itself every half an hour; an operator
    that shuffles all rows several times asks for it between its steps.
    """
    gc.collect()
    spark._jvm.System.gc()


def unit(hashed: Column) -> Column:
    """A 64-bit hash as a double in [0, 1]; keeps the order of the hash's signed value."""
    return (hashed.cast("double") + F.lit(float(2**63))) / F.lit(float(2**64))


def prefix_sums(df: DataFrame, by: list[str], hashed: str, ties: list[str], value: str, rows_per_bucket: int = 512) -> DataFrame:
    """Add `rank` (from 0, gapless) and `before` (sum of `value` over earlier rows) within each `by` group.

    Rows are ordered by the 64-bit `hashed` column, then `ties`. A group of any size is cut into
    hash ranges of about `rows_per_bucket` rows, each numbered on its own, and shifted by the prefix
    sums of the ranges, so that no task ever holds a hot group. `df` should be a staged table, as it
    is read three times.
    """
    sizes = df.groupBy(*by).agg(F.ceil(F.count("*") / rows_per_bucket).alias("n_buckets"))
    cut = df.join(sizes, by).withColumn("bucket", F.least(F.floor(unit(F.col(hashed)) * F.col("n_buckets")), F.col("n_buckets") - 1)).drop("n_buckets")
    earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.groupBy(*by, "bucket")
        .agg(F.count("*").alias("n"), F.sum(value).alias("v"))
        .select(*by, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("value_before"))
    )
    within = Window.partitionBy(*by, "bucket").orderBy(hashed, *ties)
    # The join above may leave the rows dealt by `by` alone, which would do for the window too.
    numbered = cut.repartition(*by, "bucket").withColumn("in_rank", F.row_number().over(within) - 1).withColumn("in_sum", F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    return (
        numbered.join(shifts, [*by, "bucket"])
        .withColumn("rank", (F.col("rows_before") + F.col("in_rank")).cast("long"))
        .withColumn("before", (F.col("value_before") + F.col("in_sum")).cast("long"))
        .drop("bucket", "rows_before", "value_before", "in_rank", "in_sum")
    )


def meet_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner", heavy: int = 256) -> DataFrame:
    """rows joined with groups, one row a key, on a key that is never null. `size` is the rows of a group and may be in the result.

    Groups of more than one row in `heavy` are fewer than `heavy`: they are broadcast, so that no task
    takes a hot group's rows; the others meet by a shuffle. Both should be staged tables.
    """
    total = rows.count()
    hot = groups.where(F.col(size) * heavy > total)
    first = rows.join(F.broadcast(hot), key, "left")
    hit = first.where(F.col(size).isNotNull())
    rest = first.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(F.col(size) * heavy <= total), key, how)
    return hit.unionByName(rest).select(*rows.columns, *[c for c in groups.columns if c != key])
