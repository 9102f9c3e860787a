"""The classifiers: kernels and scores against direct sums, folds, leakage, edge cases."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import TEXTS, edge_docs, empty_docs, repeated, table
from tidemark import llm
from tidemark.llm import quality, toxicity

SF1 = "/root/testdata/sf0.01"
FOLDS = {"toxic": (5, 0), "quality": (4, 2)}


def held_out(doc_id, label):
    modulus, rest = FOLDS[label]
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


# --- the kernel ---------------------------------------------------------------------------------


def brute_map(word):
    """Every subsequence of three letters within six places of each other (the start counts as one), by its weight."""
    letters, out = ["^", *word], {}
    for i, j, k in itertools.combinations(range(len(letters)), 3):
        if k - i < toxicity.SPAN:
            u = (letters[i], letters[j], letters[k])
            out[u] = out.get(u, 0.0) + toxicity.DECAY ** (k - i - 2)
    return out


def brute_likeness(a, b):
    x, y = brute_map(a), brute_map(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return (sum(v * y.get(u, 0.0) for u, v in x.items()) / norm) ** toxicity.POWER if norm else 0.0


def test_likeness_is_the_sum_over_common_subsequences():
    r = random.Random(3)
    words = ["".join(r.choice("abcde") for _ in range(n)) for n in (2, 3, 3, 5, 8, 8, 13, 30)] + ["banana", "bananas", "baxnana", "b", ""]
    marks = ["banana", "abcde", "eeeee", "abab"]
    got = toxicity.Landmarks(marks).likeness(words)
    for i, j in itertools.product(range(len(words)), range(len(marks))):
        assert got[i, j] == pytest.approx(brute_likeness(words[i], marks[j]), abs=2e-5)


def test_gaps_and_inserted_letters_cost_little():
    near = toxicity.Landmarks(["grobnak"]).likeness(["grobnak", "grxobnak", "grbnak", "meadow", "kanborg"])[:, 0]
    assert near[0] == pytest.approx(1.0, abs=1e-4) and min(near[1:3]) > 0.1 > 10 * max(near[3:])


def test_a_sentence_is_the_sum_of_its_words():
    model = toxicity.Model(0.5, ["grobnak", "meadow"], np.array([2.0, -0.5], np.float32), -1.0)
    scorer = toxicity.Scorer(model)
    text = "meadow grobnak river. grobnaks meadow"
    value = {w: sum(b * brute_likeness(w, m) for m, b in zip(model.landmarks, model.beta)) for w in ("meadow", "grobnak", "river", "grobnaks")}
    margins = [value["meadow"] + value["grobnak"] + value["river"] - 1.0, value["grobnaks"] + value["meadow"] - 1.0]
    got = scorer.features([text])[0]
    assert got[0] == pytest.approx(max(margins), abs=1e-4) and got[1] == pytest.approx(np.log1p(sum(m > 0 for m in margins)))
    assert got[3] == pytest.approx(sum(max(value[w] - 1.0, 0) for w in ("meadow", "grobnak", "river", "grobnaks", "meadow")) / 5, abs=1e-4)


def test_forgotten_tokens_are_scored_again():
    model = toxicity.Model(0.5, ["grobnak", "meadow"], np.array([2.0, -0.5], np.float32), -1.0)
    texts = [f"meadow grobnak word{i} more{i}" for i in range(300)]
    few, many = toxicity.Scorer(model, 10), toxicity.Scorer(model)
    assert np.array_equal(np.vstack([few.features([t]) for t in texts]), many.features(texts)) and len(few.known) < 20


# --- the factorisation machine ------------------------------------------------------------------


def test_pairs_are_summed_in_linear_time():
    r = np.random.default_rng(1)
    model = quality.Model(0.5, None, 0.3, r.normal(size=50), r.normal(size=(50, quality.FACTORS)))
    ids, x = np.array([3, 7, 11, 20, 49]), r.normal(size=5)
    pairs = sum(float(model.factors[ids[i]] @ model.factors[ids[j]]) * x[i] * x[j] for i in range(5) for j in range(i))
    assert quality._row(model, ids, x) == pytest.approx(0.3 + float(model.linear[ids] @ x) + pairs)


def test_the_most_common_word_is_counted_over_the_whole_text():
    at = quality.STATISTICS.index("most_common")
    tokens = ["a", "b"] * 50 + ["c"] * 140 + [f"w{i}" for i in range(60)]
    for seed in range(3):
        random.Random(seed).shuffle(tokens)
        assert quality.statistics(" ".join(tokens), tokens, ())[at] == 140 / 300
    assert quality.statistics("", [], ())[at] == 0


# --- both ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,label,limit,least", [("op7_string_kernel_toxicity", "toxic", 0.5, 0.9), ("op8_factorisation_quality", "quality", 0.7, 0.85)])
def test_scores_of_documents_never_learnt_from(spark, name, label, limit, least):
    docs, labels = table("documents", SF1), table("labels", SF1).set_index("doc_id")[label]
    got = llm.queries()[name](spark, SF1).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= limit)).all() and [held_out(d, label) for d in got.index] == list(got.held_out)
    own = [d for d in labels.index if held_out(d, label)]
    assert len(own) > 50 and np.mean([(got.score[d] >= limit) == labels[d] for d in own]) >= least


@pytest.mark.parametrize("train,score,label", [(toxicity.train, toxicity.score, "toxic"), (quality.train, quality.score, "quality")])
def test_labels_of_the_held_out_fold_are_never_read(spark, train, score, label):
    docs = spark.read.parquet(f"{SF1}/documents.parquet").limit(400)
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    modulus, rest = FOLDS[label]
    flip = F.when(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, 1 - F.col(label)).otherwise(F.col(label))
    a, b = (score(docs, train(docs, own)).select("doc_id", label_of(label)).toPandas() for own in (labels, labels.withColumn(label, flip)))
    assert a.equals(b)


def label_of(label):
    return {"toxic": "toxicity", "quality": "quality"}[label]


@pytest.mark.parametrize("train,score,label", [(toxicity.train, toxicity.score, "toxic"), (quality.train, quality.score, "quality")])
def test_edge_cases(spark, train, score, label):
    schema = f"doc_id long, {label} int, text string, label string, __id string"
    odd = [(None, 1, "clash", "clash", "clash"), (0, None, "clash", "clash", "clash"), (10**9, 1, "clash", "clash", "clash")]
    ids = [r.doc_id for r in edge_docs(spark).collect()]
    labels = spark.createDataFrame([(d, i % 2, "clash", "clash", "clash") for i, d in enumerate([*ids, *ids])] + odd, schema)
    docs = repeated(spark)
    model = train(docs, labels)
    got = score(docs, model).toPandas()
    assert len(got) == len(TEXTS) + 5 and got[label_of(label)].between(0, 1).all() and "clash" in set(got.label)
    same = got[got.text.isin(["", None]) | got.text.isna()]
    assert same.groupby(same.n_chars.fillna(-1))[label_of(label)].nunique().max() == 1
    twice = got[got.doc_id == got.doc_id[10]]
    assert len(twice) == 3 and twice[label_of(label)].nunique() == 1
    assert score(empty_docs(spark), model).count() == 0
    for none in (labels.limit(0), labels.withColumn(label, F.lit(1))):
        flat = score(docs, train(docs, none)).select(label_of(label)).distinct().collect()
        assert len(flat) == 1 and 0 < flat[0][0] < 1
    assert score(docs, train(empty_docs(spark), labels)).count() == len(TEXTS) + 5
