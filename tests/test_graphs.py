"""Strong components, the longest cycles, communities by levels: against brute force on small graphs, and dense or nested large ones."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.bindings import bind
from tidemark.operators import communities, cycles, graph

PAIR = "src long, dst long"
WEIGHTED = "src long, dst long, weight double"


def walks(edges, longest):
    nxt = {}
    for a, b in edges:
        if a != b:
            nxt.setdefault(a, set()).add(b)
    out = set()

    def walk(path):
        for b in nxt.get(path[-1], ()):
            if b == path[0] and len(path) > 1:
                out.add(tuple(path))
            elif b > path[0] and b not in path and len(path) < longest:
                walk([*path, b])

    for a in nxt:
        walk([a])
    return sorted(out, key=lambda c: (-len(c), c))


def reach(edges):
    nodes = {x for e in edges for x in e}
    to = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in to[n]:
                to[n] = to[n] | to[k]
    return to


def random_edges(seed, nodes, share):
    r = random.Random(seed)
    return sorted({(a * 3, b * 3) for a in range(nodes) for b in range(nodes) if r.random() < share})


@pytest.mark.parametrize("seed,nodes,share", [(1, 12, 0.12), (2, 15, 0.1), (3, 9, 0.3), (4, 20, 0.06)])
def test_strong_components(spark, seed, nodes, share):
    edges = random_edges(seed, nodes, share)
    to = reach(edges)
    want = {n: min(m for m in to[n] if n in to[m]) for n in to if any(n in to[m] for m in to[n] if m != n)}
    got = {r.id: r.component for r in cycles.strong_components(spark.createDataFrame(edges, PAIR), hops=2).collect()}
    assert got == want


def test_a_long_ring_and_a_chain_of_rings(spark):
    ring = [(i, (i + 1) % 30) for i in range(30)]
    rings = [(100 + 10 * k + i, 100 + 10 * k + (i + 1) % 3) for k in range(4) for i in range(3)] + [(100 + 10 * k, 110 + 10 * k) for k in range(3)]
    got = {r.id: r.component for r in cycles.strong_components(spark.createDataFrame(ring + rings, PAIR), hops=8).collect()}
    assert got == dict.fromkeys(range(30), 0) | {100 + 10 * k + i: 100 + 10 * k for k in range(4) for i in range(3)}


@pytest.mark.parametrize("seed,nodes,share,longest,most,block", [(1, 8, 0.4, 10, 50, 40), (2, 10, 0.3, 5, 20, 1000), (3, 6, 0.9, 10, 50, 64), (4, 14, 0.12, 10, 500, 10), (5, 6, 0.3, 4, 50, 12)])
def test_best_cycles_are_those_of_brute_force(spark, seed, nodes, share, longest, most, block):
    edges = random_edges(seed, nodes, share) + [(3, 3)]
    got = [tuple(r.members) for r in cycles.best_cycles(spark.createDataFrame(edges, PAIR), longest, most, block=block).collect()]
    every = walks(edges, longest)
    assert got == every[:most]
    assert cycles.count_cycles(spark.createDataFrame(edges, PAIR), 5).first()[0] == min(len(every), 5)


@pytest.mark.parametrize("seed,nodes,share,longest", [(1, 8, 0.4, 10), (2, 10, 0.3, 5), (3, 6, 0.9, 10), (4, 14, 0.12, 10), (5, 6, 0.5, 2), (6, 7, 0.6, 3), (7, 12, 0.25, 10)])
def test_all_cycles_are_those_of_brute_force(spark, seed, nodes, share, longest):
    edges = random_edges(seed, nodes, share) + [(3, 3)]
    got = sorted(((tuple(r.members), r.size) for r in cycles.all_cycles(spark.createDataFrame(edges * 2, PAIR), longest).collect()), key=lambda c: (-c[1], c[0]))
    assert got == [(c, len(c)) for c in walks(edges, longest)]


def test_more_than_fifty_cycles_are_all_given_and_counted(spark):
    edges = [(10 * k + i, 10 * k + (i + 1) % (3 + k % 8)) for k in range(70) for i in range(3 + k % 8)]
    assert len(walks(edges, 10)) == 70
    got = registry_graph(spark, "gr_cycles", edges).collect()
    assert sorted(tuple(r.members) for r in got) == sorted(walks(edges, 10))
    assert cycles.count_cycles(spark.createDataFrame(edges, PAIR)).first()[0] == 70


def test_health_counts_every_cycle(spark):
    edges = [(10 * k + i, 10 * k + (i + 1) % 3) for k in range(70) for i in range(3)]
    facts = {
        "file7": spark.createDataFrame([(1, False, 2, 3.0, 4.0)], "path_id long, is_deleted boolean, commit_count long, churn_weighted double, complexity double"),
        "edge4": spark.createDataFrame(edges, PAIR),
        "touch2": spark.createDataFrame([(1, 1)], "commit_id long, path_id long"),
    }
    with pytest.MonkeyPatch.context() as patch:
        for plans in ("history", "links"):
            patch.setattr(f"tidemark.plans.{plans}.bind", lambda _spark, _dir, name: facts[name])
        got = registry.QUERIES["agg_health"](spark, "").first()
    assert got.cycle_count == 70 and got.score == 70.0


def test_the_passport_counts_every_cycle(spark):
    small = "/root/testdata/sf0.001"
    edges = [(r.src, r.dst) for r in bind(spark, small, "edge4").collect()]
    assert registry.QUERIES["eng_passport"](spark, small).first().cycle_count == len(walks(edges, 10)) > 50


def registry_graph(spark, name, edges):
    """A registered query over given edges."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("tidemark.plans.graphs.bind", lambda *_: spark.createDataFrame(edges, PAIR))
        return registry.QUERIES[name](spark, "")


def test_starts_are_searched_in_turns(spark):
    edges = [(10 * k + i, 10 * k + (i + 1) % (2 + k)) for k in range(3) for i in range(2 + k)]
    got = [tuple(r.members) for r in cycles.best_cycles(spark.createDataFrame(edges, PAIR), longest=4, table_rows=20).collect()]
    assert got == walks(edges, 4)


def test_cycles_of_up_to_ten_files(spark):
    ring = [(i, (i + 1) % 10) for i in range(10)]
    more = [(3, 1), (7, 2), (20, 21), (21, 20), (30, 31), (40, 41), (11, 12), *[(50 + i, 50 + (i + 1) % 11) for i in range(11)]]
    got = [tuple(r.members) for r in cycles.best_cycles(spark.createDataFrame(ring + more, PAIR)).collect()]
    assert got == walks(ring + more, 10) and len(got[0]) == 10 and not any(50 in c for c in got)
    assert cycles.best_cycles(spark.createDataFrame([(1, 2), (2, 3)], PAIR)).count() == 0


def test_a_dense_core_of_two_hundred_files(spark):
    """Its cycles of ten are beyond counting. The first fifty, in order, are checked by a walk that looks no further."""
    r = random.Random(7)
    edges = [(a, b) for a in range(200) for b in range(200) if a != b and r.random() < 0.4]
    got = [tuple(x.members) for x in cycles.best_cycles(spark.createDataFrame(edges, PAIR)).collect()]
    own, want = {}, []
    for a, b in sorted(edges):
        own.setdefault(a, []).append(b)

    def walk(path):
        if len(path) == 10:
            if path[0] in own[path[-1]]:
                want.append(tuple(path))
            return
        for b in own[path[-1]]:
            if len(want) < 50 and b > path[0] and b not in path:
                walk([*path, b])

    walk([0])
    assert got == want[:50]


def test_sizes_without_a_way_back_are_not_walked(spark):
    """Three layers of files, each importing the next: cycles have 3, 6 or 9 files, never 10."""
    edges = [(a * 3 + k, b * 3 + (k + 1) % 3) for k in range(3) for a in range(12) for b in range(12)]
    got = [tuple(x.members) for x in cycles.best_cycles(spark.createDataFrame(edges, PAIR), block=64).collect()]
    assert len(got) == 50 and {len(c) for c in got} == {9} and got == sorted(got)


def modularity(edges, label, resolution=1.0):
    m, k, inside = sum(w for *_, w in edges), {}, 0.0
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inside += w * (label[a] == label[b])
    degree = {}
    for n, d in k.items():
        degree[label[n]] = degree.get(label[n], 0) + d
    return inside / m - resolution * sum(d * d for d in degree.values()) / (4 * m * m)


def partitions(nodes):
    if not nodes:
        yield {}
        return
    for rest in partitions(nodes[1:]):
        for g in [*dict.fromkeys(rest.values()), nodes[0]]:
            yield {**rest, nodes[0]: g}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_communities_are_near_the_best_partition(spark, seed):
    r = random.Random(seed)
    edges = [(a, b, float(r.randrange(1, 4))) for a in range(8) for b in range(a + 1, 8) if r.random() < (0.8 if a // 4 == b // 4 else 0.15)]
    nodes = sorted({x for e in edges for x in e[:2]})
    best = max(modularity(edges, p) for p in partitions(nodes))
    df = spark.createDataFrame(edges, WEIGHTED)
    label = {x.id: x.community for x in communities.communities(df).collect()}
    assert modularity(edges, label) >= best - 0.02
    assert graph.modularity(df, communities.communities(df)).first()[0] == pytest.approx(modularity(edges, label))


def rings(weights=(1.0, 1.0, 1.0), cliques=3, size=4):
    """Two rings of cliques, tied by one edge: ids tell ring, clique and place."""
    inner, ring, tie = weights
    out = []
    for g in range(2):
        for c in range(cliques):
            own = [g * 1000 + c * 10 + i for i in range(size)]
            out += [(a, b, inner) for a in own for b in own if a < b]
            out.append((own[0], g * 1000 + (c + 1) % cliques * 10 + 1, ring))
    return [*out, (0, 1000, tie)]


def test_levels_find_cliques_and_then_rings(spark):
    edges = rings()
    members, levels = communities.community_levels(spark.createDataFrame(edges, WEIGHTED), resolution=0.2)
    found = {}
    for r in members.collect():
        found.setdefault(r.level, {})[r.id] = r.community
    tops = levels.orderBy("level").collect()
    assert found[max(found)] == {x: x // 1000 * 1000 for e in edges for x in e[:2]}
    assert len(tops) > 1 and all(x.modularity < y.modularity for x, y in zip(tops, tops[1:])) and all(x.settled for x in tops)
    for t in tops:
        assert t.communities == len(set(found[t.level].values())) and t.modularity == pytest.approx(modularity(edges, found[t.level], 0.2))
    # Every community of a level lies within one of the next.
    for a, b in zip(sorted(found), sorted(found)[1:]):
        assert len({(found[a][x], found[b][x]) for x in found[a]}) == len(set(found[a].values()))


def test_cliques_at_plain_resolution_with_what_is_found_on_them(spark):
    df = spark.createDataFrame(rings(), WEIGHTED)
    members = communities.communities(df)
    label = {r.id: r.community for r in members.collect()}
    assert len(set(label.values())) == 6 and all(label[x] == x // 10 * 10 for x in label)
    assert graph.modularity(df, members).first()[0] == pytest.approx(modularity(rings(), label))
    # A clique has six edges within and two that leave it, those of the tie one more.
    assert {r.community: round(r.cohesion, 6) for r in graph.cohesion(df, members).collect()} == {c: round(6 / (9 if c in (0, 1000) else 8), 6) for c in set(label.values())}


def test_rounds_that_do_not_suffice_are_reported(spark):
    _, levels = communities.community_levels(spark.createDataFrame(rings(), WEIGHTED), rounds=1, most_levels=1)
    assert [r.settled for r in levels.collect()] == [False]


def test_own_weights_count_at_both_ends(spark):
    got = communities.strengths(communities.as_graph(spark.createDataFrame([(1, 1, 2.0), (2, 1, 1.0), (1, 2, 3.0)], WEIGHTED)))
    assert {r.id: r.k for r in got.collect()} == {1: 8.0, 2: 4.0}


def test_communities_find_two_cliques(spark):
    rows = [(a, b, 1.0) for s in (0, 10) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(0, 10, 0.1)]
    got = {r.id: r.community for r in communities.communities(spark.createDataFrame(rows, WEIGHTED)).collect()}
    assert got == {i: 0 for i in range(5)} | {i: 10 for i in range(10, 15)}


def test_no_edges_no_communities(spark):
    members, levels = communities.community_levels(spark.createDataFrame([], WEIGHTED))
    assert members.count() == 0 and [(r.level, r.communities, r.modularity) for r in levels.collect()] == [(1, 0, 0.0)]


def test_many_small_communities_become_other(spark):
    w = spark.createDataFrame([(10 * c + i, 10 * c + (i + 1) % 3, 1.0) for c in range(15) for i in range(3)] + [(1000, 0, 0.1)], WEIGHTED)
    members = w.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("community", (F.col("id") / 10).cast("long") * 10)
    got = {r.id: r.subsystem for r in graph.merge_small(w, members).collect()}
    assert got[1000] == "0" and sum(v == "Other" for v in got.values()) == 9 and len(set(got.values())) == 13


def test_levels_of_the_registered_graph_rise(spark):
    rows = registry.QUERIES["gr_louvain_levels"](spark, "/root/testdata/sf0.001").orderBy("level").collect()
    assert rows and all(a.modularity < b.modularity and a.communities > b.communities for a, b in zip(rows, rows[1:]))


def jobs_of(spark, work):
    """How many Spark jobs a piece of work starts."""
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_communities_of_few_edges_need_few_jobs(spark):
    edges = spark.createDataFrame(rings(cliques=12, size=6), WEIGHTED)
    assert 0 < jobs_of(spark, lambda: communities.communities(edges).collect()) <= 25


@pytest.mark.parametrize("resolution,one_task", [(1.0, 0), (1.0, 30), (0.2, 30), (0.2, 10**6)])
def test_levels_by_spark_and_in_one_task(spark, resolution, one_task):
    """No level, those from the first contraction on, or all levels in one task: 72 edges lie within the cliques, 13 between them."""
    edges = rings(cliques=6, size=4)
    edges = [(3 * b + 1, 3 * a + 1, w) for a, b, w in edges]
    members, levels = communities.community_levels(spark.createDataFrame(edges, WEIGHTED), resolution, one_task=one_task)
    found = {}
    for r in members.collect():
        assert r.id not in found.setdefault(r.level, {})
        found[r.level][r.id] = r.community
    rows = levels.orderBy("level").collect()
    assert [r.level for r in rows] == sorted(found) and len(rows) > (resolution < 1)
    for r in rows:
        label = found[r.level]
        assert set(label) == {x for e in edges for x in e[:2]} and r.communities == len(set(label.values()))
        assert r.modularity == pytest.approx(modularity(edges, label, resolution))
        assert all(c == min(x for x in label if label[x] == c) for c in label.values())
    assert all(a.modularity < b.modularity for a, b in zip(rows, rows[1:]))
    for a, b in zip(rows, rows[1:]):
        assert len(set(zip(found[a.level].values(), found[b.level].values()))) == a.communities


def test_ids_may_be_texts(spark):
    edges = [(f"{g}{a}", f"{g}{b}", 1.0) for g in "qb" for a in range(5) for b in range(a)] + [("q0", "b0", 0.1)]
    got = {r.id: r.community for r in communities.communities(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    assert got == {f"{g}{i}": f"{g}0" for g in "qb" for i in range(5)}


def test_own_weights_and_moves_that_gain_nothing_in_one_task(spark):
    """A lone edge is one community; a node with nothing but its own weight is one by itself; both levels count own weights twice."""
    edges = [(5, 4, 1.0), (9, 9, 2.0)]
    members, levels = communities.community_levels(spark.createDataFrame(edges, WEIGHTED))
    assert {r.id: r.community for r in members.collect()} == {4: 4, 5: 4, 9: 9}
    assert [(r.level, r.communities, round(r.modularity, 9), r.settled) for r in levels.collect()] == [(1, 2, round(1 - (2 / 6) ** 2 - (4 / 6) ** 2, 9), True)]


def test_registered_levels_need_few_jobs(spark):
    assert 0 < jobs_of(spark, lambda: registry.QUERIES["gr_louvain_levels"](spark, "/root/testdata/sf0.001").collect()) <= 60


def test_merging_small_communities_needs_few_jobs(spark):
    found = []
    assert 0 < jobs_of(spark, lambda: found.extend(registry.QUERIES["gr_merge_cap"](spark, "/root/testdata/sf0.001").collect())) <= 90
    ids = {x for r in bind(spark, "/root/testdata/sf0.001", "edge4").collect() for x in (r.src, r.dst)}
    assert {r.id for r in found} >= ids and len({r.id for r in found}) == len(found)
