"""Streams: commits as they arrive, request limits per key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.tables import children, remove, saved

TOUCH = "commit_id long, path_id long, author string, ts timestamp, churn double"


def commit_stream(spark: SparkSession, path: str, schema: str = TOUCH, files: int = 16) -> DataFrame:
    """Parquet files of touches as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def hourly_activity(stream: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Commits and churn by window; windows close once the watermark has passed them."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("touches"), F.sum("churn").alias("churn"))
    return rows.select(F.col("w.start").alias("start"), "touches", "churn")


#: A path's totals: what is added, and how totals of the same path are put together.
TOTALS = {"churn": F.sum, "touches": F.sum, "last_seen": F.max}


def versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[int]]:
    """bucket -> the numbers of the batches that have written it whole, in order, of those before `before`."""
    found: dict[int, list[int]] = {}
    written = sorted(int(v.removeprefix("v=")) for v in children(spark, target) if v.startswith("v="))
    for v in written:
        own = children(spark, f"{target}/v={v}") if before is None or v < before else []
        if "_SUCCESS" in own:
            for b in own:
                if b.startswith("bucket="):
                    found.setdefault(int(b.removeprefix("bucket=")), []).append(v)
    return found


def read_totals(spark: SparkSession, target: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The totals of all buckets, or of some, each in its latest version; None where nothing is written."""
    latest = {b: v[-1] for b, v in versions(spark, target, before).items() if buckets is None or b in buckets}
    paths = [f"{target}/v={v}/bucket={b}" for b, v in sorted(latest.items())]
    return spark.read.parquet(*paths) if paths else None


def keep_totals(stream: DataFrame, target: str, checkpoint: str, buckets: int = 64):
    """Per-path totals kept up to date: a batch rewrites only the buckets that hold its paths.

    Paths lie in `buckets` buckets by a hash. Each batch is reduced first; the buckets it touches are
    read in their latest version of an earlier batch, merged, and written as target/v=N/bucket=B. So a
    batch that is run again, as after a lost driver, reads what it read and replaces what it wrote.
    A bucket's version goes once a later batch begins that no longer needs it.
    """

    def merge(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        for b, written in versions(spark, target, no).items():
            for v in written[:-1]:
                remove(spark, f"{target}/v={v}/bucket={b}")
        new = batch.groupBy("path_id").agg(F.sum("churn").alias("churn"), F.count("*").alias("touches"), F.max("ts").alias("last_seen"))
        new = saved(new.withColumn("bucket", F.pmod(F.xxhash64("path_id"), F.lit(buckets)).cast("int")))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
        old = read_totals(spark, target, touched, no)
        if old is not None:
            new = new.drop("bucket").unionByName(old).groupBy("path_id").agg(*[f(c).alias(c) for c, f in TOTALS.items()])
            new = new.withColumn("bucket", F.pmod(F.xxhash64("path_id"), F.lit(buckets)).cast("int"))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={no}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LIMITED = "key string, ts timestamp, allowed boolean"


def token_bucket(requests: DataFrame, short: tuple[int, float] = (5, 60.0), long: tuple[int, float] = (50, 3600.0)) -> DataFrame:
    """requests (key, ts) -> allowed: two buckets a key, each refilled evenly over its window; both must have a token.

    A key's requests are taken one Arrow batch at a time, each in order of time, so a hot key never sits
    in memory whole; a bucket's clock does not go back for a late request.
    """

    def step(key, batches, state: GroupState):
        left = list(state.get) if state.exists else [float(short[0]), 0.0, float(long[0]), 0.0]
        for pdf in batches:
            out = []
            for ts in pdf["ts"].sort_values(kind="stable"):
                now = ts.timestamp()
                for i, (most, width) in ((0, short), (2, long)):
                    if left[i + 1]:
                        left[i] = min(float(most), left[i] + max(0.0, now - left[i + 1]) * most / width)
                    left[i + 1] = max(now, left[i + 1])
                ok = left[0] >= 1 and left[2] >= 1
                if ok:
                    left[0], left[2] = left[0] - 1, left[2] - 1
                out.append((key[0], ts, ok))
            state.update(tuple(left))
            yield pd.DataFrame(out, columns=["key", "ts", "allowed"])

    return requests.groupBy("key").applyInPandasWithState(step, LIMITED, "a double, b double, c double, d double", "append", GroupStateTimeout.NoTimeout)
