"""Change coupling of files and modules, and coupled pairs that no import explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tables import saved


def changesets(touches: DataFrame, most: int = 30, item: str = "path_id") -> DataFrame:
    """(commit_id, item) once each, without commits of more than `most` items.

    Filtering before pairs are made bounds them by most * (most - 1) / 2 a commit. The distinct, the
    window and a self-join that follows share one shuffle on commit_id.
    """
    own = touches.where(F.col(item).isNotNull()).select("commit_id", F.col(item).alias("item")).repartition("commit_id").distinct()
    n = F.count("*").over(Window.partitionBy("commit_id"))
    return own.withColumn("n", n).where(F.col("n") <= most).drop("n")


def item_pairs(sets: DataFrame) -> DataFrame:
    """Sorted pairs of items that a commit changes together."""
    a, b = sets.select("commit_id", F.col("item").alias("a")), sets.select("commit_id", F.col("item").alias("b"))
    return a.join(b, "commit_id").where("a < b").select("commit_id", "a", "b")


def coupling(touches: DataFrame, most: int = 30, item: str = "path_id", min_shared: int = 5, min_degree: float = 0.3, floor: int = 2) -> DataFrame:
    """a, b, shared_revs, degree, avg_revs, low_confidence.

    degree divides by the revisions of the less active item. Where no pair reaches min_shared, pairs
    of `floor` shared revisions are given with low_confidence; one scalar decides, in the same plan.
    """
    sets = changesets(touches, most, item)
    revs = sets.groupBy("item").agg(F.count("*").alias("revs"))
    shared = item_pairs(sets).groupBy("a", "b").agg(F.count("*").alias("shared_revs")).where(F.col("shared_revs") >= floor)
    rows = (
        shared.join(revs.select(F.col("item").alias("a"), F.col("revs").alias("revs_a")), "a")
        .join(revs.select(F.col("item").alias("b"), F.col("revs").alias("revs_b")), "b")
        .withColumn("degree", F.col("shared_revs") / F.least("revs_a", "revs_b"))
        .withColumn("avg_revs", (F.col("revs_a") + F.col("revs_b")) / 2)
        .where(F.col("degree") >= min_degree)
    )
    # An aggregate without keys is one row.
    any_full = rows.agg(F.coalesce(F.max(F.col("shared_revs") >= min_shared), F.lit(False)).alias("any_full"))
    kept = rows.crossJoin(F.broadcast(any_full)).where((F.col("shared_revs") >= min_shared) | ~F.col("any_full"))
    return kept.select("a", "b", "shared_revs", "degree", "avg_revs", (~F.col("any_full")).alias("low_confidence"))


def coupling_of(touches: DataFrame, item, most: int = 30, min_shared: int = 5, min_degree: float = 0.3, floor: int = 2) -> DataFrame:
    """The rows of coupling() that have this item at one end, from the commits that hold it.

    Only where none of them reaches min_shared does it matter what other pairs of the history reach.
    """
    sets = changesets(touches, most)
    mine = sets.where(F.col("item") == F.lit(item)).select("commit_id")
    shared = sets.join(mine, "commit_id", "left_semi").groupBy("item").agg(F.count("*").alias("shared_revs")).where((F.col("shared_revs") >= floor) | (F.col("item") == F.lit(item)))
    revs = sets.join(shared.select("item"), "item", "left_semi").groupBy("item").agg(F.count("*").alias("revs"))
    own = mine.agg(F.count("*").alias("own_revs"))
    rows = shared.where(F.col("item") != F.lit(item)).join(revs, "item").crossJoin(F.broadcast(own)).withColumn("degree", F.col("shared_revs") / F.least("revs", "own_revs")).where(F.col("degree") >= min_degree)
    rows = saved(rows.select(F.least("item", F.lit(item)).alias("a"), F.greatest("item", F.lit(item)).alias("b"), "shared_revs", "degree", ((F.col("revs") + F.col("own_revs")) / 2).alias("avg_revs")))
    full = rows.where(F.col("shared_revs") >= min_shared)
    if not full.isEmpty() or not coupling(touches, most, min_shared=min_shared, min_degree=min_degree, floor=floor).where("not low_confidence").isEmpty():
        return full.withColumn("low_confidence", F.lit(False))
    return rows.withColumn("low_confidence", F.lit(True))


def module_coupling(touches: DataFrame, module: str = "module", most: int = 10, **options) -> DataFrame:
    """The same over sets of modules: a module counts once a commit, never the sum of its files' pairs."""
    return coupling(touches, most, module, **options)


def both_ends(pairs: DataFrame, value: str) -> DataFrame:
    return pairs.select(F.col("a").alias("path_id"), value).unionByName(pairs.select(F.col("b").alias("path_id"), value))


def max_coupling(pairs: DataFrame) -> DataFrame:
    return both_ends(pairs, "degree").groupBy("path_id").agg(F.max("degree").alias("max_coupling"))


def hidden_dependencies(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Coupled pairs without an import in either direction."""
    known = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def confidence(shared: Column, low: Column) -> Column:
    return F.when(low, "low").when(shared >= 10, "high").otherwise("medium")


def confidence_score(label: Column) -> Column:
    return F.when(label == "low", 0.4).when(label == "high", 0.9).otherwise(0.65)


def hidden_findings(hidden: DataFrame) -> DataFrame:
    """One finding for each hidden pair."""
    from tidemark.functions import numbers, texts

    label = confidence(F.col("shared_revs"), F.col("low_confidence"))
    key = F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))
    return hidden.select(
        F.lit("hidden_dependency").alias("category"), numbers.severity(F.col("degree"), 0.65, 0.45).alias("severity"), confidence_score(label).alias("confidence"),
        F.col("a").cast("string").alias("subject"), texts.signature("hidden_dependency", key).alias("signature"),
    )
