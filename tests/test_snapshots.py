"""Facts are scanned once a head."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import snapshots

HEADS = "repo string, head string"


def facts_of(asked):
    def scan(moved):
        asked.append({(r.repo, r.head) for r in moved.collect()})
        rows = moved.select("repo", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("path_id"), F.concat("head", F.lit("!")).alias("seen"))
        return {"files": rows, "commits": rows.select("repo", F.col("path_id").alias("commit_id"))}

    return scan


def state(store):
    return {(r.repo, r.head, r.seen) for r in store.read("files").collect()}


def test_unmoved_heads_start_no_scan(spark, tmp_path):
    store, asked = snapshots.Snapshots(spark, f"file://{tmp_path}/s", ["files", "commits"]), []
    heads = lambda *rows: spark.createDataFrame(rows, HEADS)
    scan = facts_of(asked)
    assert store.refresh(heads(("a", "1"), ("b", "1")), scan) == {"new": 2, "changed": 0, "reuse": 0}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    assert store.refresh(heads(("a", "1"), ("b", "1")), scan) == {"new": 0, "changed": 0, "reuse": 2}
    # Nothing was scanned or written.
    assert asked == [{("a", "1"), ("b", "1")}] and {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")} == files
    assert store.refresh(heads(("a", "2"), ("b", "1"), ("c", "1")), scan) == {"new": 1, "changed": 1, "reuse": 1}
    assert asked[1] == {("a", "2"), ("c", "1")} and state(store) == {("a", "2", "2!"), ("b", "1", "1!"), ("c", "1", "1!")}
    # The files of b are those of the first run.
    assert all(p.stat().st_mtime_ns == t for p, t in files.items() if "repo=b" in str(p))
    assert store.read("files").count() == 9 and store.read("commits").count() == 9
    # A repository that is not looked at keeps its facts, and so does one whose head cannot be read.
    assert store.refresh(heads(("a", "3"), ("b", None), ("z", None)), scan) == {"new": 0, "changed": 1, "reuse": 1}
    assert state(store) == {("a", "3", "3!"), ("b", "1", "1!"), ("c", "1", "1!")}


def test_a_publication_that_did_not_end_is_not_seen(spark, tmp_path):
    store, asked = snapshots.Snapshots(spark, f"file://{tmp_path}/s", ["files", "commits"]), []
    scan = facts_of(asked)
    store.refresh(spark.createDataFrame([("a", "1")], HEADS), scan)

    def broken(moved):
        found = scan(moved)
        return {**found, "commits": found["commits"].withColumn("commit_id", F.raise_error(F.lit("lost")))}

    with pytest.raises(Exception, match="lost"):
        store.refresh(spark.createDataFrame([("a", "2")], HEADS), broken)
    assert state(store) == {("a", "1", "1!")}
    assert store.refresh(spark.createDataFrame([("a", "2")], HEADS), scan)["changed"] == 1 and state(store) == {("a", "2", "2!")}


def test_a_head_that_comes_back(spark, tmp_path):
    store, asked = snapshots.Snapshots(spark, f"file://{tmp_path}/s", ["files", "commits"]), []
    for head in ("007", "1e3", "007"):
        store.refresh(spark.createDataFrame([("a", head)], HEADS), facts_of(asked))
    assert state(store) == {("a", "007", "007!")} and len(asked) == 3


def test_tables_are_named_plainly(spark, tmp_path):
    with pytest.raises(ValueError):
        snapshots.Snapshots(spark, str(tmp_path), ["heads"])
    with pytest.raises(KeyError):
        snapshots.Snapshots(spark, str(tmp_path), ["files"]).read("other")
