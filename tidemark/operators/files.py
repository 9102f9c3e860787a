"""Files from touches: totals, decay, risk, health, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers, texts
from tidemark.operators.tables import global_rank

DAY = 86400.0


def days_between(later, earlier):
    return F.timestamp_diff("SECOND", earlier, later) / DAY


def file_totals(touches: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """churn_total, commit_count, first_seen, last_seen; is_deleted where the final tree lacks the path."""
    found = touches.groupBy("path_id").agg(F.sum("churn").alias("churn_total"), F.count_distinct("commit_id").alias("commit_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    if tree is None:
        return found.withColumn("is_deleted", F.lit(False))
    here = tree.select("path_id").distinct().withColumn("here", F.lit(True))
    return found.join(here, "path_id", "left").withColumn("is_deleted", F.col("here").isNull()).drop("here")


def churn_decay(touches: DataFrame, half_life: int = 365, window: int = 365) -> DataFrame:
    """churn_weighted halves every half_life days before the last commit; churn_recent counts the window's lines."""
    last = touches.agg(F.max("ts").alias("last_ts"))
    age = days_between(F.col("last_ts"), F.col("ts"))
    return touches.crossJoin(F.broadcast(last)).groupBy("path_id").agg(
        F.sum(F.col("churn") * F.pow(F.lit(0.5), age / half_life)).alias("churn_weighted"), F.coalesce(F.sum(F.when(age <= window, F.col("churn"))), F.lit(0.0)).alias("churn_recent")
    )


def risk(files: DataFrame, ends: DataFrame) -> DataFrame:
    """risk_score of live files, its confidence, severity and hotspot_rank.

    .60 of churn x complexity, .25 of the greatest coupling, .15 of commits, each min-max scaled over
    the run. One aggregate gives all the ranges.
    """
    own = files.where("not is_deleted").join(ends, "path_id", "left").select("path_id", "commit_count", (F.col("churn_weighted") * F.col("complexity")).alias("cc"), F.coalesce("max_coupling", F.lit(0.0)).alias("mc"))
    ranges = own.agg(*[f(c).alias(n + c) for c in ("cc", "mc", "commit_count") for n, f in (("lo_", F.min), ("hi_", F.max))])
    scaled = lambda c: numbers.min_max(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    score = 0.60 * scaled("cc") + 0.25 * scaled("mc") + 0.15 * scaled("commit_count")
    found = own.crossJoin(F.broadcast(ranges)).select("path_id", score.alias("risk_score"), F.least(F.lit(1.0), F.col("commit_count") / 10).alias("confidence"))
    return found.withColumn("severity", numbers.severity(F.col("risk_score"), 0.70, 0.40))


def hotspot_rank(risks: DataFrame) -> DataFrame:
    return global_rank(risks, [F.col("risk_score").desc(), F.col("path_id").asc()], "hotspot_rank")


def health(files: DataFrame, risks: DataFrame, cycles: DataFrame, hidden: DataFrame) -> DataFrame:
    """100 less 40 x the share of high-risk live files, 6 a cycle (30 at most) and 3 a hidden pair (30 at most)."""
    n = files.where("not is_deleted").agg(F.count("*").alias("files"))
    high = risks.agg(F.count_if(F.col("risk_score") >= 0.60).alias("high"))
    one = n.crossJoin(high).crossJoin(cycles).crossJoin(hidden.agg(F.count("*").alias("hidden_count")))
    ratio = F.when(F.col("files") == 0, 0.0).otherwise(F.col("high") / F.col("files"))
    score = 100 - F.least(F.lit(100.0), 40 * ratio) - F.least(F.lit(30.0), 6.0 * F.col("cycle_count")) - F.least(F.lit(30.0), 3.0 * F.col("hidden_count"))
    return one.select(F.greatest(F.lit(0.0), score).alias("score"), ratio.alias("high_risk_ratio"), "cycle_count", "hidden_count")


def evidence(touches: DataFrame, commits: DataFrame) -> DataFrame:
    """The commit that speaks for each file: a fix before others, then the latest."""
    own = touches.select("path_id", "commit_id").distinct().join(commits, "commit_id")
    best = F.max(F.struct("is_fix", "ts", "commit_id"))
    return own.groupBy("path_id").agg(best.alias("b")).select("path_id", F.col("b.commit_id").alias("evidence_id"), F.col("b.is_fix").alias("is_fix"))


def risk_findings(risks: DataFrame, most: int = 10) -> DataFrame:
    top = risks.orderBy(F.desc("risk_score"), "path_id").limit(most)
    key = F.col("path_id").cast("string")
    return top.select(F.lit("risk").alias("category"), "severity", "confidence", key.alias("subject"), texts.signature("risk", key).alias("signature"))


def rank_findings(findings: DataFrame) -> DataFrame:
    """Global rank by ten times the severity's weight plus confidence; ties by category and signature."""
    weighed = findings.withColumn("weight", numbers.severity_weight(F.col("severity")) * 10 + F.col("confidence"))
    return global_rank(weighed, [F.desc("weight"), F.asc("category"), F.asc("signature")])


def percentile(df: DataFrame, value: str, fraction: float, rule: str = "floor", by: list[str] | None = None) -> DataFrame:
    """The value at a rank rule's index, for each group or over all rows (see numbers.rank_index).

    All rows get a global rank by group and value, so neither a hot group nor all values meet in one task.
    """
    by = by or []
    ranked = global_rank(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("value")), [*map(F.col, by), F.col("value")], "__rank")
    ends = ranked.groupBy(*by).agg(F.min("__rank").alias("first"), F.count("*").alias("total"))
    at = ends.select((F.col("first") + numbers.rank_index(F.col("total"), fraction, rule)).alias("__rank"))
    return ranked.join(at, "__rank").select(*by, "value")
