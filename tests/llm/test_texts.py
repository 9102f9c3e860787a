"""Secrets, exact copies, near copies, mixing against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.cases import SF, TEXTS, edge_docs, empty_docs, prose, repeated, table
from tidemark import llm
from tidemark.llm import exact_dedup, mixing, secrets, simhash
from tidemark.llm.common import prefix_sums, stage

SF1 = "/root/testdata/sf0.01"


# --- secrets ------------------------------------------------------------------------------------


def brute_spans(text):
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ):
        flags = re.ASCII if kind == "assign" else 0
        out += [(m.start(), len(out), m.end(), kind) for m in re.finditer(pattern.replace("(?i:", "(?ia:") if flags else pattern, text or "") if len(m[group]) >= least]
    order = {"assign": 0, "access": 1, "hex": 2}
    return [f"{k}:{a}:{z}" for a, _, z, k in sorted(out, key=lambda x: (x[0], order[x[3]]))]


def same_base(row, text):
    want = brute_spans(text)
    assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    for k in ("assign", "access", "hex"):
        assert getattr(row, f"n_{k}") == sum(w.startswith(k) for w in want)
    assert set(want) <= set(row.spans.split(",")) or not want


def test_secrets(spark):
    docs = table("documents", SF1)
    text, got = dict(zip(docs.doc_id, docs.text)), llm.queries()["op4_trigram_secrets"](spark, SF1).toPandas()
    assert sorted(got.doc_id) == sorted(text)
    for r in got.itertuples():
        same_base(r, text[r.doc_id])


def test_every_rule_finds_through_the_index_what_a_full_scan_finds(spark):
    got = secrets.scan(edge_docs(spark)).toPandas()
    for r in got.itertuples():
        want = secrets.spans_of(r.text or "", secrets.RULES, {x.kind for x in secrets.RULES})
        assert [(f["start"], f["stop"], f["kind"]) for f in r.found] == want
    kinds = {f["kind"] for fs in got.found for f in fs}
    assert {"assign", "access", "hex", "forge_token", "private_key", "url_login"} <= kinds
    assert "clash" in set(got.fp) and secrets.scan(empty_docs(spark)).count() == 0
    assert secrets.scan(repeated(spark)).count() == len(TEXTS) + 5


def test_queries_are_necessary_conditions():
    assert secrets.trigram_query("[0-9a-f]+") == secrets.ANY
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert len(secrets.trigram_query(secrets.BASE[0].pattern)) >= 5


@settings(max_examples=60, deadline=None)
@given(st.text("pasword=:tkenAKI_-y\"' 01", max_size=60))
def test_a_text_that_matches_satisfies_the_query(text):
    low = text.lower()
    for r in secrets.RULES:
        if re.search(r.pattern, text):
            assert any(all(t in low for t in c) for c in secrets.trigram_query(r.pattern))


# --- exact copies -------------------------------------------------------------------------------


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_copies(spark):
    docs = table("documents")
    got = llm.queries()["op6_exact_dedup"](spark, SF).toPandas().set_index("doc_id")
    groups = defaultdict(list)
    for d, t in zip(docs.doc_id, docs.text):
        groups[norm(t)].append(d)
    for t, ids in groups.items():
        for d in ids:
            assert tuple(got.loc[d]) == (min(ids), len(ids), d == min(ids), hashlib.sha256(t.encode()).hexdigest())


def test_index_outlives_its_batch(spark):
    docs = edge_docs(spark)
    index = exact_dedup.open_index(spark, docs, buckets=4)
    first = exact_dedup.drop_copies(docs, index).toPandas()
    assert sorted(first.doc_id) == sorted({norm(t): i for i, t in sorted(((r[0], r[1]) for r in docs.select("doc_id", "text").collect()), reverse=True)}.values())
    index.close()
    again = exact_dedup.DigestIndex(spark, index.path, buckets=4)
    more = spark.createDataFrame([(900, "new text"), (901, "one"), (902, "new  text")], "doc_id long, text string")
    assert [r.doc_id for r in exact_dedup.drop_copies(more, again).collect()] == [900]
    plan = again.new(spark.createDataFrame([(bytearray(32), 1)], "digest binary, keep_id long"), "next")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    again.close()


def test_a_batch_that_is_run_again_gives_the_same_rows(spark):
    docs = edge_docs(spark)
    index = exact_dedup.open_index(spark, docs, buckets=2)
    first = spark.createDataFrame([(1, "one"), (2, "new text")], "doc_id long, text string")
    assert exact_dedup.drop_copies(first, index, batch="a").count() == 2
    runs = [sorted(r.doc_id for r in exact_dedup.drop_copies(docs, index, batch="b").collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) > 10
    files = index.read("none").groupBy("digest").count()
    assert files.where("count > 1").count() == 0 and files.count() == len(runs[0]) + 2
    index.close()
    again = exact_dedup.DigestIndex(spark, index.path, buckets=2)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs, again, batch="b").collect()) == runs[0]
    assert exact_dedup.drop_copies(docs, again, batch="c").count() == 0
    again.close()


def test_exact_copies_of_edge_cases(spark):
    index = exact_dedup.open_index(spark, repeated(spark), buckets=2)
    got = exact_dedup.drop_copies(repeated(spark), index).toPandas()
    assert got.text.map(norm).is_unique and set(got.text.map(norm)) == {norm(t) for t in [*TEXTS, "no id"]}
    index.close()
    index = exact_dedup.open_index(spark, empty_docs(spark), buckets=2)
    assert exact_dedup.drop_copies(empty_docs(spark), index).count() == 0
    index.close()


# --- near copies --------------------------------------------------------------------------------


def brute_fp(text, words=3):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if x]
    if not w:
        return 0
    s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: dict):
    """id -> smallest id reachable by links of at most two bits."""
    top = {i: i for i in fps}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_copies(spark):
    docs = table("documents", SF1)
    got = llm.queries()["op10_simhash_dedup"](spark, SF1).toPandas().set_index("doc_id")
    fps = {d: brute_fp(t) for d, t in zip(docs.doc_id, docs.text)}
    want = brute_components(fps)
    assert len(set(want.values())) < len(want)
    for d in fps:
        assert tuple(got.loc[d]) == (f"{fps[d]:016x}", want[d])


def test_near_copies_of_edge_cases(spark):
    got = simhash.near_classes(repeated(spark)).toPandas()
    assert len(got) == len(TEXTS) + 5
    fps = {i: brute_fp(t) for i, t in [(r[0], r[1]) for r in edge_docs(spark).select("doc_id", "text").collect()]}
    want = brute_components(fps)
    for r in got[got.row_id.notna()].itertuples():
        assert (r.fp % 2**64, r.component_id) == (fps[int(r.row_id)], want[int(r.row_id)])
    assert simhash.near_classes(empty_docs(spark)).count() == 0
    kept = simhash.keep_first(repeated(spark)).toPandas()
    assert "clash" in set(kept.fp) and kept.doc_id.isna().sum() == 3


@pytest.mark.parametrize("limit,plan", [(64, None), (2, None), (2, [([*range(32)], 1), ([*range(32, 64)], 0)]), (3, [([*range(40)], 0), ([*range(40, 60)], 1), ([*range(60, 64)], 0)])])
def test_every_link_is_found_at_any_bucket_limit(spark, limit, plan):
    import random

    r = random.Random(limit)
    fps = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(10):
            fps.add(base)
            base ^= 1 << r.randrange(64)
            base ^= 1 << r.randrange(64)
            fps.add(base ^ 1 << r.randrange(64))
    own = dict(enumerate(fps))
    nodes = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in own.items()], "id long, fp long")
    want = {i: c for i, c in brute_components(own).items()}
    got = {r.id: r.label for r in simhash.components(simhash.near_pairs(nodes, 2, limit, plan)).collect()}
    assert {i: got.get(i, i) for i in own} == want


def brute_sets(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def changed(text, every):
    """The text with one word in `every` replaced."""
    w = text.split(" ")
    w[every // 2 :: every] = [f"changed{i}" for i in range(len(w[every // 2 :: every]))]
    return " ".join(w)


def test_one_document_of_each_group_of_near_copies_stays(spark):
    docs = table("documents", SF1)[["doc_id", "text"]].head(300)
    long = [t for t in docs.text if t and len(t.split()) > 80][:40]
    planted = [(10_000 + 10 * n + i, changed(t, every)) for n, t in enumerate(long) for i, every in enumerate((50, 70, 12))]
    rows = [(int(d), t) for d, t in zip(docs.doc_id, docs.text)] + planted
    sets = {d: brute_sets(t) for d, t in rows}
    top = {d: d for d in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    holders = defaultdict(list)
    for d, own in sets.items():
        for x in own or {()}:
            holders[x].append(d)
    shared = Counter((a, b) for ds in holders.values() for a, b in itertools.combinations(sorted(ds), 2))
    for (a, b), n in shared.items():
        if sets[a] == sets[b] or n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    want = {d: find(d) for d in sets}
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row_id: r.component_id for r in simhash.similar_classes(made).collect()}
    assert got.keys() == want.keys()
    gone = {d for d in want if want[d] != d}
    assert len(gone) > 60
    # The fingerprints are a filter: nothing unlike is linked, and at most one copy in fifty is missed.
    assert all(want[d] == want[c] for d, c in got.items())
    assert sum(got[d] == d for d in gone) <= len(gone) / 50
    kept = {r.doc_id for r in simhash.keep_first(made).collect()}
    assert kept == {d for d, c in got.items() if d == c}


def test_similar_pairs_of_every_kind_are_linked(spark):
    """Recall against brute force on all pairs, by kind of edit and length; a filter on fingerprints alone loses some of each."""
    import random

    r = random.Random(9)
    kinds = defaultdict(list)

    def add(kind, *texts):
        kinds[kind].append(range(len(made), len(made) + len(texts)))
        made.extend(" ".join(t) for t in texts)

    made: list[str] = []
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    for n, length in itertools.product(range(25), (9, 24, 120, 600)):
        a, block = fresh(length), fresh(20)
        add("repeated", a + block * 5, a + block * (10 + n % 20))
        add("appended", a, a + fresh(max(1, length // 5)))
        changed = [*a]
        for i in r.sample(range(length), max(1, length // 60)):
            changed[i] = f"c{i}"
        add("scattered", a[::-1], changed[::-1])
    sets = [brute_sets(t) for t in made]
    got = {row.row_id: row.component_id for row in simhash.similar_classes(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    top = list(range(len(made)))
    for a, b in itertools.combinations(range(len(made)), 2):
        if (n := len(sets[a] & sets[b])) and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            top = [min(top[a], top[b]) if x in (top[a], top[b]) else x for x in top]
    assert {i: top[i] for i in got} == got
    assert sum(got[a] == got[b] for a, b in kinds["repeated"]) > 48


def test_large_group_of_near_copies_is_met_through_leaders_and_blocks(spark):
    import random

    r = random.Random(3)
    base, texts = [f"w{i}" for i in range(100)], []
    for _ in range(150):
        own = [*base]
        for i in r.sample(range(100), r.randrange(4)):
            own[i] = f"c{r.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [brute_sets(t) for t in texts]
    top = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (n := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            top = [min(top[a], top[b]) if x in (top[a], top[b]) else x for x in top]
    got = {row.row_id: row.component_id for row in simhash.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == top


def test_near_copies_by_similarity_of_edge_cases(spark):
    got = simhash.similar_classes(repeated(spark)).toPandas()
    assert len(got) == len(TEXTS) + 5
    ids = {t: [r[0] for r in edge_docs(spark).select("doc_id", "text").collect() if r[1] == t] for t in TEXTS}
    by_id = got[got.row_id.notna()].set_index("row_id").component_id
    blank = min(i for t in (None, "", " \t\n ") for i in ids[t])
    assert all(by_id[i] == blank for t in (None, "", " \t\n ") for i in ids[t])
    assert by_id[ids["one"][0]] == ids["one"][0] and by_id[ids["two words"][0]] == ids["two words"][0]
    assert got[got.row_id.isna()].component_id.notna().sum() == 2  # "no id" equals no row with an id
    assert simhash.similar_classes(empty_docs(spark)).count() == 0


def test_thresholds_are_allocated_by_cost():
    costs = [[0, 1, 9, 99], [0, 50, 60, 70], [0, 1, 9, 99]]
    chosen = simhash.allocate(costs, 2)
    assert sum(chosen) == 0 and chosen == [1, -1, 0] or chosen == [0, -1, 1]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "src long, dst long")
    got = {r.id: r.label for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


# --- mixing -------------------------------------------------------------------------------------


def tokens_of(t):
    return max(1, -(-len((t or "").encode()) // 4))


def test_mix_holds_to_its_weights(spark):
    docs = table("documents", SF1)
    got = llm.queries()["op9_temperature_mixing"](spark, SF1).toPandas()
    n = dict(zip(docs.doc_id, docs.text.map(tokens_of)))
    assert set(got.doc_id) == set(n) and (got.tokens == got.doc_id.map(n)).all()
    total = defaultdict(int)
    for d, s in zip(docs.doc_id, docs.source):
        total[s if s is not None else "(none)"] += n[d]
    budget = {s: g.tokens.sum() for s, g in got.groupby("source")}
    for s, g in got.groupby("source"):
        assert budget[s] / total[s] <= 2.0 + g.tokens.max() / total[s] + 1e-6
        g = g.sort_values("start")
        assert (g.start.values == g.tokens.cumsum().values - g.tokens.values).all() or g["pass"].max() > 0
        assert (g[g["pass"] == 0].doc_id.is_unique) and len(g[g["pass"] == 0]) == sum(docs.source == s)
    assert abs(sum({r.source: r.weight for r in got.itertuples()}.values()) - 1) < 1e-9
    for b, g in got[got.block < got.block.max()].groupby("block"):
        for s, own in g.groupby("source"):
            assert abs(own.tokens.sum() - own.weight.iloc[0] * (1 << 20)) <= 2 * got.tokens.max()


@pytest.mark.parametrize("target", [0.5, 0.9, 1.05])
def test_exponent_meets_the_entropy(spark, target):
    spread = spark.createDataFrame([("a", 80, 0.8), ("b", 15, 0.15), ("c", 5, 0.05)], "src string, src_tokens long, share double")
    a = mixing.find_exponent(spread, mixing.Mix(target_entropy=target))
    w = [p**a for p in (0.8, 0.15, 0.05)]
    h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert a == 1.0 if target < 0.61 else abs(h - target) < 1e-4


def test_exponent_holds_to_the_repeats(spark):
    spread = spark.createDataFrame([("a", 80, 0.8), ("b", 15, 0.15), ("c", 5, 0.05)], "src string, src_tokens long, share double")
    a = mixing.find_exponent(spread, mixing.Mix(max_repeats=3))
    assert abs((0.05 / 0.8) ** (a - 1) - 3) < 1e-3


def test_mixing_of_edge_cases(spark):
    placed, found = mixing.plan_mix(repeated(spark), mixing.Mix())
    got = placed.toPandas()
    assert len(got[got["pass"] == 0]) == len(TEXTS) + 5 and set(got.src) == {"hot", "(none)"} and found.count() == 2
    assert mixing.plan_mix(empty_docs(spark), mixing.Mix())[0].count() == 0
    assert mixing.mixed(empty_docs(spark)).count() == 0
    once = mixing.mixed(edge_docs(spark)).toPandas()
    assert set(once.doc_id) == {r.doc_id for r in edge_docs(spark).collect()} and "clash" in set(once.key)


def test_many_passes_are_planned_at_once(spark):
    docs = spark.createDataFrame([(i, "x" * 4000, "big") for i in range(300)] + [(1000, "y", "small"), (1001, "z", "small")], "doc_id long, text string, source string")
    placed, found = mixing.plan_mix(docs, mixing.Mix(target_entropy=0.69))
    got = placed.where("src = 'small'").toPandas()
    most = {r.src: r.budget for r in found.collect()}["small"]
    assert len(got) == most > 100_000 and got["pass"].max() == (most - 1) // 2
    assert sorted(got.start) == list(range(most)) and got.groupby("pass").row_id.nunique().iloc[:-1].eq(2).all()


def test_hot_groups_are_dealt_by_their_buckets(spark):
    docs = spark.range(3000).select(F.lit("hot").alias("src"), F.xxhash64("id").alias("h"), "id", F.lit(1).alias("v"))
    found = prefix_sums(stage(docs, "test"), ["src"], "h", ["id"], "v", rows_per_bucket=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
    assert sorted((r["rank"], r.before) for r in found.collect()) == [(i, i) for i in range(3000)]


def test_the_mix_has_the_uses_that_are_planned(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    uses = mixing.plan_mix(docs, mixing.Mix())[0].groupBy("row_id").count().toPandas().set_index("row_id")["count"]
    real = mixing.mixed(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert (uses.sort_index() == real.sort_index()).all()
    assert prose(1, 3)


def test_the_order_of_shingles_counts_all_texts(spark):
    sets = [simhash.shingle_set(simhash.word_hashes(f"a b c d e f{i} g{i % 7}")) for i in range(9000)]
    made = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sets)], "no long, own array<int>")
    counts = simhash.shingle_counts(made)
    assert np.array_equal(counts, np.bincount(np.concatenate(sets) & (simhash.COUNTED - 1), minlength=simhash.COUNTED))
    common = simhash.shingle_set(simhash.word_hashes("a b c d e"))
    places = simhash.shingle_places(counts)
    assert counts.sum() == sum(map(len, sets)) and counts[common[0] & (simhash.COUNTED - 1)] >= 9000
    assert all(simhash.set_head(x, 0.5, places).tolist() == sorted(x.tolist(), key=lambda v: (counts[v & (simhash.COUNTED - 1)], v))[:2] for x in sets[:50])
