"""The run catalog: which run to read, which to keep, how facts and insights are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class RunNotFound(LookupError):
    """No run to read."""


class RunPending(RuntimeError):
    """The stage that a view needs has not ended."""


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each repository (ties: the greatest id)."""
    return runs.groupBy("repo_id").agg(F.max(F.struct("started_at", "run_id"))["run_id"].alias("run_id"))


def chosen_runs(requests: DataFrame, repos: DataFrame, runs: DataFrame) -> DataFrame:
    """requests (repo_id, run_id or null): the run asked for, else the repository's current one, else the newest."""
    own = requests.select("repo_id", F.col("run_id").alias("asked")).join(repos.select("repo_id", "current_run_id"), "repo_id", "left").join(latest_runs(runs), "repo_id", "left")
    return own.select("repo_id", F.coalesce("asked", "current_run_id", "run_id").alias("run_id"))


def evictable(runs: DataFrame, now, keep: int = 3, days: int = 7) -> DataFrame:
    """Superseded runs beyond each repository's `keep` newest that are `days` old or more."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.where("status = 'superseded'").withColumn("r", F.row_number().over(w)).where((F.col("r") > keep) & (F.col("started_at") <= now - F.expr(f"interval {days} days"))).drop("r")


def stale(runs: DataFrame, now, minutes: int = 20) -> DataFrame:
    return runs.where((F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"interval {minutes} minutes")))


def interned(known: DataFrame, paths: DataFrame) -> DataFrame:
    """known (path_id, path) and the new ones of `paths`, numbered on in order of path; ids never change."""
    from tidemark.operators.files import global_rank

    new = paths.select("path").where("path is not null").distinct().join(known, "path", "left_anti")
    top = known.agg(F.coalesce(F.max("path_id"), F.lit(0)).alias("top"))
    numbered = global_rank(new, [F.asc("path")], "n").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n") + 1).alias("path_id"), "path")
    return known.select("path_id", "path").unionByName(numbered)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def touched(old: DataFrame, seen: DataFrame, minutes: int = 60) -> DataFrame:
    """last_viewed moves at most once in `minutes`."""
    last = seen.groupBy("repo_id").agg(F.max("at").alias("at"))
    due = F.col("at").isNotNull() & (F.col("last_viewed").isNull() | (F.col("at") >= F.col("last_viewed") + F.expr(f"interval {minutes} minutes")))
    return old.join(last, "repo_id", "left").select("repo_id", F.when(due, F.col("at")).otherwise(F.col("last_viewed")).alias("last_viewed"))


class Store:
    """Tables below a folder, in partitions: facts by repo_id (replaced whole), insights by run_id (only added)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def write_facts(self, name: str, df: DataFrame) -> None:
        """Replaces the partitions of the repositories in df, and no others."""
        df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("repo_id").parquet(f"{self.root}/facts/{name}")

    def write_insight(self, name: str, df: DataFrame, run_id: str) -> None:
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{self.root}/insights/{name}")

    def facts(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/facts/{name}")

    def drop_run(self, name: str, run_id: str) -> None:
        """Deletes the partition's folder through Spark's file system."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/insights/{name}/run_id={run_id}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, view: str, run_id: str | None = None, repo: DataFrame | None = None, runs: DataFrame | None = None, stages: dict[str, str] | None = None) -> DataFrame:
        """An insight of one run: the one named, else the current, else the newest; only its partition is read."""
        if run_id is None and runs is not None:
            row = (chosen_runs(runs.select("repo_id").distinct().withColumn("run_id", F.lit(None).cast("string")), repo, runs) if repo is not None else latest_runs(runs)).first()
            run_id = row["run_id"] if row else None
        if run_id is None:
            raise RunNotFound(view)
        if stages and stages.get(view, "ready") not in ("ready", "failed", "skipped"):
            raise RunPending(view)
        return self.spark.read.parquet(f"{self.root}/insights/{view}").where(F.col("run_id") == run_id)
