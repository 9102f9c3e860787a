"""The pipeline, stage by stage against brute force, and on edge cases."""

import itertools
import re

import corpus_pipeline
from tests.llm.cases import SF, empty_docs, repeated
from tests.llm.test_ids import check_pieces
from tests.llm.test_texts import brute_sets, norm
from tidemark.llm import mixing, toxicity


def tables(spark, docs, at, labels=None):
    """A folder with documents and labels."""
    docs.write.parquet(f"file://{at}/documents.parquet")
    rows = labels or [(r.doc_id, 1, 0) for r in docs.limit(5).collect()]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    return f"file://{at}"


def stages(spark, sf_dir):
    """(name, rows before, rows after) of each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in corpus_pipeline.STAGES:
        after = function(spark, docs, sf_dir)
        found = after.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        yield name, docs.toPandas(), found
        docs = spark.createDataFrame(after.rdd, after.schema)


def near_leaders(ids, texts):
    """Brute force over all pairs: the smallest id of each group linked by a similarity of 0.8."""
    top, sets = {i: i for i in ids}, [brute_sets(t) for t in texts]
    for (i, a), (j, b) in itertools.combinations(zip(ids, sets, strict=True), 2):
        n = len(a & b)
        if a == b or (n and n >= 0.8 * (len(a) + len(b) - n)):
            x, y = top[i], top[j]
            top = {k: min(x, y) if v in (x, y) else v for k, v in top.items()}
    return {i for i, v in top.items() if i == v}


def test_every_stage_keeps_what_brute_force_keeps(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = [(10_000 + r.doc_id, re.sub(" ", "  ", r.text or ""), r.lang, r.source, r.n_chars) for r in docs.where("doc_id % 9 = 0").collect()]
    near = [(20_000 + r.doc_id, f"{r.text} and one more", r.lang, r.source, r.n_chars) for r in docs.where("doc_id % 7 = 0 and n_chars > 600").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    sf_dir = tables(spark, docs.unionByName(spark.createDataFrame(copies + near, docs.schema)), tmp_path, labels)
    seen = {}
    for name, before, after in stages(spark, sf_dir):
        seen[name] = len(before), len(after)
        if name == "toxicity":
            all_docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
            scorer = toxicity.Scorer(toxicity.train(all_docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
            assert set(after.doc_id) == set(before.doc_id[scorer.score(list(before.text)) < 0.5])
            clean = {d for d, _, t in labels if not t}
            assert len(clean & set(after.doc_id)) >= 0.95 * len(clean & set(before.doc_id))
        elif name == "exact dedup":
            assert set(after.doc_id) == set(before.groupby(before.text.map(norm)).doc_id.min())
        elif name == "simhash near-dedup":
            assert set(after.doc_id) == near_leaders(list(before.doc_id), list(before.text)) and len(after) < len(before)
        elif name == "temperature mixing":
            uses = after.groupby("doc_id").size()
            assert set(uses.index) == set(before.doc_id) and uses.max() <= 3 and uses.min() == 1
            planned = mixing.plan_mix(spark.createDataFrame(before, docs.schema), mixing.Mix())[0].groupBy("row_id").count().collect()
            assert {r.row_id: r["count"] for r in planned} == uses.to_dict()
        else:
            once = after.drop_duplicates(["doc_id", "start", "length"])
            assert set(once.doc_id) == set(before.doc_id) and after.length.sum() == after[after.start == 0].doc_tokens.sum()
            assert after.groupby("sequence_id").length.sum().max() <= 2048
    assert seen["exact dedup"][1] < seen["exact dedup"][0] < len(copies) + len(near) + docs.count()


def test_stages_take_edge_cases(spark, tmp_path):
    sizes = [(name, len(before), len(after)) for name, before, after in stages(spark, tables(spark, repeated(spark), tmp_path))]
    assert [n for n, *_ in sizes] == [n for n, _ in corpus_pipeline.STAGES] and all(after for *_, after in sizes)


def test_an_empty_table_stays_empty(spark, tmp_path):
    sf_dir = tables(spark, empty_docs(spark), tmp_path, [(1, 1, 1)])
    assert [len(after) for *_, after in stages(spark, sf_dir)] == [0] * 5


def test_run_packs_what_the_stages_leave(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " + "words " * i, "en", "s", 5) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.run(spark, tables(spark, docs, tmp_path)).toPandas().rename(columns={"doc_id": "row_id"})
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_pieces(got, {d: texts[d] for d in set(got.row_id)}, 2048, 1.0)
