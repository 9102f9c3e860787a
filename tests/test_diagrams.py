"""Projection to visible nodes, infrastructure, callers, tests of sources, grounding: hand-made cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import diagram, narrative, testmap

SF = "/root/testdata/sf0.001"


def test_owners_are_the_first_folder_that_is_closed(spark):
    files = {1: "src/a/x.py", 2: "src/b/deep/y.py", 3: "src/main.py", 4: "lib/z.py", 5: "top.py", 6: "lib/open/w.py", 7: "src/b/deep/more/q.py"}
    opened = ["src", "src/b", "src/b/deep/more", "lib/open", "absent"]
    got = {r.path_id: r.owner for r in diagram.owners(spark.createDataFrame(list(files.items()), "path_id long, path string"), spark.createDataFrame([(f,) for f in opened], "folder string")).collect()}
    assert got == {1: "src/a", 2: "src/b/deep", 3: "src/main.py", 4: "lib", 5: "top.py", 6: "lib", 7: "src/b/deep"}


def reachable(pairs):
    to = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    for k, n in itertools.product(list(to), list(to)):
        if k in to[n]:
            to[n] |= to[k]
    return to


def test_projection_is_that_of_brute_force(spark):
    r = random.Random(3)
    owner = {i: f"g{i % 7}" for i in range(40)}
    edges = sorted({(r.randrange(40), r.randrange(40)) for _ in range(60)})
    hidden = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(30)})
    hidden = [(a, b, 0.3 + (a + b) % 5 / 10, a + b) for a, b in hidden]
    got = diagram.projected(
        spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(hidden, "a long, b long, degree double, shared_revs long"), spark.createDataFrame(list(owner.items()), "path_id long, owner string"), samples=2, weak_beyond=10
    ).collect()
    by_file, groups = reachable(edges), {(owner[a], owner[b]) for a, b in edges if owner[a] != owner[b]}
    by_group, want = reachable(sorted(groups)), {}
    for s, t in groups:
        own = [(a, b) for a, b in edges if (owner[a], owner[b]) == (s, t)]
        round_ = any(a in by_file.get(b, ()) for a, b in own) or s in by_group.get(t, ())
        want["import", s, t] = (len(own), round_, None, None, own[:2], len(groups) > 10 and len(own) < 2 and not round_)
    for s, t in {tuple(sorted((owner[a], owner[b]))) for a, b, *_ in hidden if owner[a] != owner[b]}:
        own = [h for h in hidden if tuple(sorted((owner[h[0]], owner[h[1]]))) == (s, t)]
        want["hidden", s, t] = (len(own), False, max(h[2] for h in own), sum(h[3] for h in own), [h[:2] for h in own][:2], False)
    assert {(x.kind, x.source, x.target): (x.edges, x.in_cycle, x.max_degree, x.shared_revs, [tuple(p) for p in x.file_pairs], x.weak) for x in got} == want


def test_weak_edges_are_hidden_only_where_there_are_many(spark):
    owner = spark.createDataFrame([(i, f"g{i}") for i in range(8)], "path_id long, owner string")
    none = spark.createDataFrame([], "a long, b long, degree double, shared_revs long")
    edges = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(6, 7), (7, 6)], "src long, dst long")
    weak = lambda n: {(r.source, r.target) for r in diagram.projected(edges, none, owner, weak_beyond=n).where("weak").collect()}
    assert weak(7) == set() and weak(6) == {("g0", f"g{i}") for i in range(1, 6)}


FILES = {
    1: "pkg/orders.py", 2: "pkg/test_orders.py", 3: "tests/test_orders.py", 4: "pkg/bills.py", 5: "checks/bills_test.py", 6: "a/same.py", 7: "b/same.py", 8: "c/test_same.py",
    9: "web/cart.tsx", 10: "web/cart.test.tsx", 11: "web/__tests__/cart.spec.tsx", 12: "src/main/java/x/Pay.java", 13: "src/test/java/x/PayTests.java", 14: "src/main/java/y/IT.java",
    15: "src/test/java/y/IT.java", 16: "mod/src/test/java/PayIT.java", 17: "tests/conftest.py", 18: "pkg/lonely.py", 19: "web/cart.js", 20: "tests/helper.py", 21: "top.py", 22: "test_top.py",
}


def test_tests_point_at_sources(spark):
    files = spark.createDataFrame(list(FILES.items()), "path_id long, path string")
    edges = spark.createDataFrame([(20, 18), (20, 17), (2, 1), (18, 1), (3, 4)], "src long, dst long")
    got = {(r.test_id, r.source_id): r.rule for r in testmap.test_map(files, edges).collect()}
    assert got == {
        (2, 1): "mirror",  # and an import, which says less
        (3, 1): "stem", (3, 4): "import", (5, 4): "stem",
        (10, 9): "mirror", (11, 9): "stem",  # cart.js is of another language
        (13, 12): "mirror", (16, 12): "stem", (20, 18): "import", (22, 21): "mirror",
    }


def test_gaps_by_share_of_changes(spark):
    files = spark.createDataFrame([(1, "a.py", 5), (2, "b.py", 4), (3, "c.py", 9), (4, "d.py", 9), (5, "test_a.py", 9)], "path_id long, path string, commit_count long")
    tests = spark.createDataFrame([(50, 1, "stem"), (51, 1, "import"), (52, 2, "stem"), (53, 3, "stem")], "test_id long, source_id long, rule string")
    touches = [(c, 1) for c in range(10)] + [(0, 50), (0, 51), (0, 50)] + [(c, 2) for c in range(4)] + [(c, 3) for c in range(5)] + [(4, 53), (77, 53)]
    got = {r.path_id: (r.classification, r.ratio, r.tests) for r in testmap.test_gaps(files, tests, spark.createDataFrame(touches, "commit_id long, path_id long")).collect()}
    # One of ten is idle; four commits are too few to say so; one of five is not below a fifth.
    assert got == {1: ("stale_test", 0.1, 2), 2: ("tracked", 0.0, 1), 3: ("tracked", 0.2, 1), 4: ("no_test", None, 0)}


def test_all_classes_are_in_the_registered_query(spark):
    assert {r.classification for r in registry.QUERIES["eng_test_gaps"](spark, SF).collect()} == {"no_test", "stale_test", "tracked"}


def infra(spark, paths, declared=(), entries=(), groups=()):
    rows = diagram.infrastructure(
        spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(list(declared), "ecosystem string, package string, path string"),
        spark.createDataFrame(list(entries), "path string, evidence string"), spark.createDataFrame(list(groups), "path string, grp string"),
    )
    return {r.id: r for r in rows.collect()}


def test_every_rule_of_infrastructure(spark):
    own = {"name": "x/{}", "path": "{}", "start": "x/{}prod", "ending": "x/any{}", "workflow": ".github/workflows/any{}"}
    paths = {own[kind].format(key): i for i, _, _, kind, key, _ in diagram.PATH_RULES}
    packages = [("npm", name.upper().replace("-", "_"), f"m/{name}", i) for (i, _), names in diagram.STORES.items() for name in names]
    got = infra(spark, [*paths, "x/plain.py", "Dockerfile/readme.md", "workflows/a.yml", ".github/workflows/a.md", "x/.gitlab-ci.yml"], [(e, p, m) for e, p, m, _ in packages])
    assert set(got) == {*paths.values(), *(p[3] for p in packages)}
    assert {i: r.category for i, r in got.items()} == {**{i: c for i, c, *_ in diagram.PATH_RULES}, **{i: "datastore" for i, _ in diagram.STORES}}
    assert got["infra:github-actions"].evidence == ["2 workflow file(s) in .github/workflows"] and sorted(got["infra:docker"].paths) == ["x/any.dockerfile", "x/dockerfile", "x/dockerfile.prod"]


def test_evidence_is_cut_and_runs_are_told(spark):
    many = [("Maven", "org.postgresql:postgresql", f"m{i:02}/pom.xml") for i in range(20)] + [("PyPI", "Redis", "r.txt"), ("PyPI", "redisx", "r.txt")]
    entries = [("a/x", "Dockerfile CMD"), ("b/x", "Dockerfile ENTRYPOINT"), ("b/y", "Procfile web"), ("c/x", "Dockerfile CMD"), ("d/x", "package.json bin")]
    got = infra(spark, ["Dockerfile"], many, entries, [("a/x", "ga"), ("b/x", "gb"), ("b/y", "gb"), ("d/x", "gd")])
    assert set(got) == {"infra:docker", "infra:postgresql", "infra:redis"} and got["infra:docker"].runs_groups == ["ga", "gb"]
    store = got["infra:postgresql"]
    assert store.evidence == [f"declared dependency org.postgresql:postgresql in m{i:02}/pom.xml" for i in range(5)] and store.paths == [f"m{i:02}/pom.xml" for i in range(10)] and store.runs_groups == []


@pytest.mark.parametrize(
    "kinds,want",
    [(["cli", "graph_inferred", "web_server"], (["g0", "g2"], ["cli", "web_server"])), (["graph_inferred", "build", "graph_inferred"], (["g0", "g2"], ["graph_inferred"])), (["build", "test_root"], None), ([], None)],
)
def test_callers(spark, kinds, want):
    entries = spark.createDataFrame([(f"f{i}", k) for i, k in enumerate(kinds)] + [("nowhere", "cli")], "path string, kind string")
    groups = spark.createDataFrame([(f"f{i}", f"g{i}") for i in range(3)], "path string, grp string")
    got = [(r.group_ids, r.entry_kinds) for r in diagram.actor(entries, groups).collect()]
    assert got == ([want] if want else [])


FACTS = [("s", "loc", 1234.0, None), ("s", "share", 0.62, None), ("s", "average", 12.4, None), ("s", "path", None, "src/core/engine.py"), ("s", "file", None, "engine.py"), ("s", "fan_in", 0.0, None), ("t", "loc", 7.0, None)]
SENTENCES = {
    "It has 1,234 lines.": None, "It has about 1,200 lines!": None, "Some 1,000 lines, or 1,235?": None, "It has 1,236 lines.": "ungrounded_number",
    "Roughly 60% of it, or 62%, or 0.62.": None, "61% of it.": "ungrounded_number", "About 12 a week, 12.4 to be exact.": None, "A score of 12.5.": "ungrounded_number",
    "Seven or 7.": "ungrounded_number", "No fan_in: 0.": None, "The file SRC/core/engine.py (see average).": None, "Look at Engine.py, not at core/engine.py.": "ungrounded_reference", "Look at motor.py.": "ungrounded_reference", "See engine.py.": None,
    "Its riskScore is fine.": "ungrounded_reference", "Its hotspot_rank is known.": None, "A snake_case name.": "ungrounded_reference", "It has 1,234 lines": "looks_truncated",
    'He said "it has 1,234 lines."': None, "": "looks_truncated", "x" * 600 + ".": "too_long", "Version v1.2 and 3x are no figures.": None, "Both 99 and odd_name.": "ungrounded_number",
    "Ends with a blank. \n": None,
}


def test_sentences_are_grounded(spark):
    texts = [(i, "s", t) for i, t in enumerate(SENTENCES)] + [(1000, "t", "It has 7 lines."), (1001, "t", "It has 1,234 lines."), (1002, "t", None), (1003, "unknown", "Nothing to say.")]
    df = spark.createDataFrame(texts, "text_id long, subject string, text string")
    facts = spark.createDataFrame(FACTS, "subject string, name string, value double, words string")
    got = {r.text_id: r.reason for r in narrative.validated(df, facts, spark.createDataFrame([("hotspot_rank",)], "name string")).collect()}
    assert {t: got[i] for i, t in enumerate(SENTENCES)} == SENTENCES
    assert (got[1000], got[1001], got[1002], got[1003]) == (None, "ungrounded_number", "looks_truncated", None)


def test_roundings(spark):
    rows = spark.createDataFrame([(12.4,), (0.0,), (-37.0,), (0.005,)], "v double").select("v", narrative.roundings(F.col("v")).alias("r")).collect()
    got = {r.v: set(r.r) for r in rows}
    assert got[12.4] == {12.4, 12.0, 10.0, 0.0} and got[0.0] == {0.0} and {-37.0, -35.0, -40.0, -25.0, -50.0} <= got[-37.0] and 0.005 in got[0.005]


def test_exploded_facts_are_not_broadcast(spark):
    """Facts look small on disk; what their numbers and names allow must not meet in the driver."""
    from tidemark.registry import QUERIES

    plan = QUERIES["nar_validate"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
