"""gr_layers runs over all edges of the table, against brute force."""

from tidemark import registry
from tidemark.bindings import bind

SF = "/root/testdata/sf0.001"


def test_layers_of_all_edges(spark):
    links = {(r.src % 12, r.dst % 12) for r in bind(spark, SF, "edge4").collect() if r.src % 12 != r.dst % 12}
    groups = {g for e in links for g in e}
    reach = {g: {b for a, b in links if a == g} for g in groups}
    for _ in groups:
        reach = {g: own | {x for b in own for x in reach[b]} for g, own in reach.items()}
    scc = {g: min([g, *(b for b in reach[g] if g in reach[b])]) for g in groups}
    level = dict.fromkeys(groups, 0)
    for _ in groups:
        for a, b in links:
            if scc[a] != scc[b]:
                for g in (x for x in groups if scc[x] == scc[b]):
                    level[g] = max(level[g], min(level[a] + 1, 7))
    assert {r.grp: r.level for r in registry.QUERIES["gr_layers"](spark, SF).collect()} == level
