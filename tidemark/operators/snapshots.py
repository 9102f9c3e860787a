"""Facts of repositories by head: scanned once a head, published by one pointer, used again while the head stands."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.tables import children

#: What is done with a repository: its head is unknown, has moved, or stands.
ACTIONS = ["new", "changed", "reuse"]
POINTER = "repo string, head string"


def compared(heads: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, head, action) of heads (repo, head) against the heads whose facts are known.

    A repository without a readable head (null) keeps the facts it has; without any it is left out.
    """
    met = heads.select("repo", "head").join(known.select("repo", F.col("head").alias("was")), "repo", "left")
    same = F.col("head").isNull() | (F.col("head") == F.col("was"))
    action = F.when(F.col("was").isNull(), "new").when(same, "reuse").otherwise("changed")
    return met.where("head is not null or was is not null").select("repo", F.coalesce("head", "was").alias("head"), action.alias("action"))


class Snapshots:
    """Fact tables below `path`: path/<table>/repo=R/head=H, and one pointer table, path/heads/v=N, which says what counts.

    A publication writes the facts of moved repositories first and the next pointer last; readers follow
    the highest pointer that is whole, so they see all of a publication or nothing of it. Run again after
    a lost driver, it replaces what it had written.
    """

    def __init__(self, spark: SparkSession, path: str, tables: list[str]):
        if bad := [t for t in tables if not re.fullmatch(r"\w+", t) or t == "heads"]:
            raise ValueError(f"tables are named by letters and digits, and not heads: {bad}")
        self.spark, self.path, self.tables = spark, path, tables

    def _version(self) -> int:
        """The number of the pointer that counts; 0 where there is none."""
        found = [int(v[2:]) for v in children(self.spark, f"{self.path}/heads") if v.startswith("v=")]
        return max((n for n in found if "_SUCCESS" in children(self.spark, f"{self.path}/heads/v={n}")), default=0)

    def known(self) -> DataFrame:
        """(repo, head) of the facts that count."""
        n = self._version()
        return self.spark.read.schema(POINTER).parquet(f"{self.path}/heads/v={n}") if n else self.spark.createDataFrame([], POINTER)

    def read(self, table: str) -> DataFrame:
        """The facts that count: partitions by repo and head, pruned by the pointers."""
        if table not in self.tables:
            raise KeyError(table)
        found = self.spark.read.parquet(f"{self.path}/{table}").schema
        # Folders are names, whatever numbers they look like.
        own = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("repo", "head") else f.dataType) for f in found])
        return self.spark.read.schema(own).parquet(f"{self.path}/{table}").join(self.known(), ["repo", "head"], "left_semi")

    def refresh(self, heads: DataFrame, scan: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, int]:
        """Scan the repositories whose head has moved, and publish. Returns how many were new, changed and reused.

        scan is given (repo, head) of those alone, and returns each table's facts with a column repo. Where
        no head has moved it is not called, and nothing is written. heads has one row a repository.
        """
        plan = compared(heads, self.known()).persist()
        try:
            counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
            moved = plan.where("action <> 'reuse'").select("repo", "head")
            if counts.get("new", 0) + counts.get("changed", 0):
                facts = scan(moved)
                if set(facts) != set(self.tables):
                    raise ValueError(f"a scan gives {sorted(self.tables)}, not {sorted(facts)}")
                for table, rows in facts.items():
                    # Only the partitions of moved heads are replaced.
                    out = rows.join(moved, "repo").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                    out.partitionBy("repo", "head").parquet(f"{self.path}/{table}")
                gone = self.known().join(plan.select("repo"), "repo", "left_anti")
                plan.select("repo", "head").unionByName(gone).write.mode("overwrite").parquet(f"{self.path}/heads/v={self._version() + 1}")
            return {a: counts.get(a, 0) for a in ACTIONS}
        finally:
            plan.unpersist()
