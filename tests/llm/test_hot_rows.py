"""Thousands of equal rows, rows without an id, and callers' columns that bear internal names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SF, edge_docs, prose
from tidemark.llm import exact_dedup, mixing, packing, quality, secrets, simhash, toxicity
from tidemark.llm.common import fresh, meet_groups

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string"


def test_equal_rows_are_packed_in_all_groups(spark):
    rows = [(None, "the same short text of a row without an id", "en", "s")] * 4000 + [(i, prose(i, 60), "en", "s") for i in range(800)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = packing.pack(docs, PATH, group_bytes=1 << 14)
    sizes = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert got.where("row_id is null").count() >= 4000
    whole = got.where("row_id is null").agg(F.sum("length"), F.max("doc_tokens")).first()
    assert whole[0] == 4000 * whole[1]


@pytest.mark.parametrize("kind", ["null", "repeated", "unique"])
def test_the_mix_is_the_one_that_is_planned(spark, kind):
    own = {"null": lambda i: None, "repeated": lambda i: i % 7, "unique": lambda i: i}[kind]
    rows = [(own(i), f"text of ten or more words number {i % 300}", "en", "small") for i in range(1000)] + [(10_000 + i, prose(i, 40), "en", "large") for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    placed, found = mixing.plan_mix(docs, mixing.Mix(max_repeats=1.5))
    real = mixing.mixed(docs, mixing.Mix(max_repeats=1.5))
    planned = {r.src: (r.n, r.t) for r in placed.groupBy("src").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    delivered = {r.source: (r.n, r.t) for r in real.groupBy("source").agg(F.count("*").alias("n"), F.sum(mixing.estimated_tokens(F.col("text"))).alias("t")).collect()}
    assert planned == delivered and 1400 < planned["small"][0] < 1600
    budget = {r.src: r.budget for r in found.collect()}
    assert all(0 <= planned[s][1] - budget[s] < 100 for s in budget)
    assert planned["large"][0] >= 2000 and {r["count"] for r in real.where("source = 'large'").groupBy("doc_id").count().collect()} <= {1, 2}


#: Every name that an operator that keeps its caller's columns uses, now or in an earlier version.
OWN = ["__use", "__src", "__full", "__cut", "__digest", "__keep", "__n", "__key", "__kinds", "__gone", "no", "src", "full", "cut", "use", "digest", "keep_id", "keep_rows", "key", "kinds", "component_id", "h", "tokens", "row_id", "fp"]


def named(spark):
    rows = [(i, prose(i % 40, 30) + (" password = 'hunter2secret'" if i % 9 == 0 else ""), "en", f"s{i % 3}", *[f"{n}{i}" for n in OWN]) for i in range(80)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {n} string" for n in OWN))


def kept_columns(before, after, extra=()):
    assert after.columns == [*before.columns, *extra]
    own = {r.doc_id: tuple(r) for r in before.collect()}
    rows = after.collect()
    assert rows and all(tuple(r)[: len(before.columns)] == own[r.doc_id] for r in rows)
    return rows


def test_columns_of_callers_are_left_alone(spark):
    docs = named(spark)
    assert len(kept_columns(docs, mixing.mixed(docs))) >= 80
    index = exact_dedup.open_index(spark, docs)
    assert len(kept_columns(docs, exact_dedup.drop_copies(docs, index))) < 80
    index.close()
    assert len(kept_columns(docs, simhash.keep_first(docs))) < 80
    assert any(r.found for r in kept_columns(docs, secrets.scan(docs), ["found"]))
    kept_columns(docs, toxicity.score(docs, toxicity.Model(0.5)), ["toxicity"])


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Use int, use_0 int, cut int")
    assert fresh(df, "use", "cut", "x", "x") == ["use_1", "cut_0", "x", "x_0"]


def test_hot_groups_meet_by_broadcast_and_others_by_a_shuffle(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    found = meet_groups(rows, groups.where("n > 1"), "k", "n", "left")
    assert found.columns == ["k", "id", "n", "first"] and found.count() == 4000
    want = {r.k: (r.n, r.first) for r in groups.collect()}
    assert all((r.n, r.first) == (want[r.k] if want[r.k][0] > 1 else (None, None)) for r in found.collect())


def test_edge_documents_stay_whole(spark):
    docs = edge_docs(spark)
    assert sorted(map(repr, mixing.mixed(docs).distinct().collect())) == sorted(map(repr, docs.distinct().collect()))


def test_quality_reads_whole_tables(spark):
    got = quality.QUERIES["op8_factorisation_quality"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
