"""Graph operators over edge tables (src, dst): components, searches, cycles, ranks, communities."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths, texts
from tidemark.operators.tables import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge with src <> dst: label is the smallest id reachable.

    Alternating stars: each id ties its larger neighbours to the smallest one, then its smaller ones,
    until every component is one star. Paths halve each round, edges never grow in number, and hubs
    are met by partial aggregation and by joins that AQE can split.
    """
    now = saved(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if seen == mark:
            break
        mark = seen
    tops = now.select(F.col("v").alias("id")).distinct().withColumn("label", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(tops)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def inferred_entries(edges: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """Files that nothing imports and that import `least` others or more."""
    return degrees(edges).where((F.col("in_degree") == 0) & (F.col("out_degree") >= least)).orderBy(F.desc("out_degree"), "id").limit(most)


def layering(edges: DataFrame) -> DataFrame:
    """Imports from ui straight to db (skip), or from a lower layer to a higher one (inverted). src and dst are paths."""
    order = F.create_map(*[F.lit(x) for kv in paths.LAYER_ORDER.items() for x in kv])
    own = edges.withColumn("from_layer", paths.layer(F.col("src"))).withColumn("to_layer", paths.layer(F.col("dst"))).where("from_layer <> to_layer")
    kind = F.when((F.col("from_layer") == "ui") & (F.col("to_layer") == "db"), "skip").when(F.element_at(order, F.col("from_layer")) > F.element_at(order, F.col("to_layer")), "inverted")
    return own.withColumn("kind", kind).where("kind is not null")


def bfs(edges: DataFrame, starts: DataFrame, depth: int | None = 6, reverse: bool = False) -> DataFrame:
    """(id, hops) of everything within `depth` edges of the starts (hops 0; None: however far): one join and anti-join a level."""
    step = edges.select(F.col("dst").alias("at"), F.col("src").alias("id")) if reverse else edges.select(F.col("src").alias("at"), F.col("dst").alias("id"))
    front = saved(starts.select("id").distinct().withColumn("hops", F.lit(0)))
    seen = front
    for hops in itertools.count(1) if depth is None else range(1, depth + 1):
        nxt = step.join(front.select(F.col("id").alias("at")), "at", "left_semi").select("id").distinct().join(seen.select("id"), "id", "left_anti")
        front = saved(nxt.withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start, goal) -> DataFrame:
    """The shortest import path from start to goal, else from goal to start; ties to the smallest ids. Searches until nothing new is met."""
    for a, z, direction in ((start, goal, "forward"), (goal, start, "reverse")):
        front = edges.sparkSession.range(1).select(F.lit(a).alias("id"), F.array(F.lit(a)).alias("path"))
        seen = front.select("id")
        while True:
            hit = front.where(F.col("id") == F.lit(z)).select("path", F.lit(direction).alias("direction"))
            if not hit.isEmpty():
                return hit
            nxt = front.join(edges.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
            front = saved(nxt.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
            if front.isEmpty():
                break
            seen = seen.unionByName(front.select("id"))
    return edges.sparkSession.createDataFrame([], f"path array<{edges.schema['src'].dataType.simpleString()}>, direction string")


def top_cycles(found: DataFrame, most: int = 50) -> DataFrame:
    return found.orderBy(F.desc("size"), "members").limit(most)


def architecture_findings(found: DataFrame, violations: DataFrame) -> DataFrame:
    """The longest cycles and all layering violations, by severity and then size.

    Cycles are high from five files on, med from three, with confidence 1; skipped layers are high and
    inverted ones med, with .75. found: members, size; violations: src, dst (ids), kind.
    """
    sizes = F.when(F.col("size") >= 5, "high").when(F.col("size") >= 3, "med").otherwise("low")
    key = F.array_join(F.array_sort(F.transform("members", lambda x: x.cast("string"))), "|")
    cycle = top_cycles(found).select(F.lit("cycle").alias("kind"), sizes.alias("severity"), F.lit(1.0).alias("confidence"), F.col("members")[0].alias("path_id"), "size", texts.signature("architecture", key).alias("signature"))
    edge = F.concat_ws("|", "kind", F.col("src").cast("string"), F.col("dst").cast("string"))
    layer = violations.select("kind", F.when(F.col("kind") == "skip", "high").otherwise("med").alias("severity"), F.lit(0.75).alias("confidence"), F.col("src").alias("path_id"), F.lit(1).alias("size"), texts.signature("architecture", edge).alias("signature"))
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "med", 1).otherwise(0)
    return cycle.unionByName(layer).orderBy(rank.desc(), F.desc("size"), "signature")


def pagerank(weighted: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 100) -> DataFrame:
    """(id, rank) on the undirected weighted graph (src, dst, weight).

    Power iterations until the ranks change by less than `tolerance` a node in sum. The edges are
    dealt by their source once; the change, one number, reaches the driver every fifth round, when
    the ranks are written.
    """
    both = weighted.select("src", "dst", "weight").unionByName(weighted.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    share = saved(both.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "p"))
    ids = saved(share.select(F.col("src").alias("id")).distinct())
    n = max(ids.count(), 1)
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    for no in range(most_rounds):
        old = ranks
        sent = share.join(ranks.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("got")).withColumnRenamed("dst", "id")
        ranks = ids.join(sent, "id", "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if no % 5 == 4:
            step = saved(ranks.join(old.withColumnRenamed("rank", "old"), "id"))
            ranks = step.select("id", "rank")
            if (step.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tolerance * n:
                break
    return ranks


def graph_weights(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Undirected weights: one for each import, and 1.5 times the coupling degree."""
    one = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(1.0).alias("weight"))
    two = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), (1.5 * F.col("degree")).alias("weight"))
    return one.unionByName(two).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def modularity(weighted: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the weighted modularity of a partition (id, community); 0 without edges."""
    a, b = members.select(F.col("id").alias("src"), F.col("community").alias("ca")), members.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = weighted.join(a, "src").join(b, "dst")
    ends = e.select(F.col("ca").alias("c"), "weight").unionByName(e.select(F.col("cb").alias("c"), "weight"))
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("inw"))
    per = ends.groupBy("c").agg(F.sum("weight").alias("deg")).join(inside, "c", "left")
    m = e.agg(F.sum("weight").alias("m"))
    term = F.coalesce("inw", F.lit(0.0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)
    return per.crossJoin(F.broadcast(m)).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("modularity"))


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """internal / (internal + external) edges of each community; 0 without edges."""
    a, b = members.select(F.col("id").alias("src"), F.col("community").alias("ca")), members.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    ends = e.where("ca = cb").select(F.col("ca").alias("community"), F.lit(1).alias("i"), F.lit(0).alias("x"))
    for c in ("ca", "cb"):
        ends = ends.unionByName(e.where("ca <> cb").select(F.col(c).alias("community"), F.lit(0).alias("i"), F.lit(1).alias("x")))
    sums = ends.groupBy("community").agg(F.sum("i").alias("internal"), F.sum("x").alias("external"))
    sizes = members.groupBy("community").agg(F.count("*").alias("files"))
    return sizes.join(sums, "community", "left").select("community", "files", F.coalesce(F.col("internal") / (F.col("internal") + F.col("external")), F.lit(0.0)).alias("cohesion"))


def merge_small(weighted: DataFrame, members: DataFrame, least: int = 3, most: int = 12) -> DataFrame:
    """Communities of fewer than `least` join their strongest neighbour of full size, else "Unclustered";
    beyond the `most` largest all are "Other"."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    a, b = members.select(F.col("id").alias("src"), F.col("community").alias("ca")), members.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = weighted.join(a, "src").join(b, "dst").where("ca <> cb")
    links = e.select("ca", "cb", "weight").unionByName(e.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "weight")).groupBy("ca", "cb").agg(F.sum("weight").alias("w"))
    big = sizes.where(F.col("n") >= least).select(F.col("community").alias("cb"))
    best = links.join(big, "cb").groupBy("ca").agg(F.min_by("cb", F.struct(-F.round("w", 9), "cb")).alias("to"))
    moved = sizes.where(F.col("n") < least).join(best.withColumnRenamed("ca", "community"), "community", "left")
    moved = moved.select("community", F.coalesce(F.col("to").cast("string"), F.lit("Unclustered")).alias("label"))
    named = members.join(moved, "community", "left").select("id", F.coalesce("label", F.col("community").cast("string")).alias("label"))
    largest = named.where("label <> 'Unclustered'").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most)
    own = named.join(F.broadcast(largest.select("label", F.lit(True).alias("kept"))), "label", "left")
    return own.select("id", F.when(F.col("kept") | (F.col("label") == "Unclustered"), F.col("label")).otherwise("Other").alias("subsystem"))


def group_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Edges summed by the groups of their ends (owner: id, grp)."""
    a, b = owner.select(F.col("id").alias("src"), F.col("grp").alias("from_group")), owner.select(F.col("id").alias("dst"), F.col("grp").alias("to_group"))
    return edges.join(a, "src").join(b, "dst").where("from_group <> to_group").groupBy("from_group", "to_group").agg(F.count("*").alias("edges"))


def group_levels(links: DataFrame, depth: int = 8) -> DataFrame:
    """(grp, level) over group edges: the longest path from a root in the condensed graph, at most depth - 1.

    Groups on a cycle share a level: they are condensed to the smallest group of their component first.
    """
    core = saved(links.select(F.col("from_group").alias("src"), F.col("to_group").alias("dst")).distinct())
    groups = core.select(F.col("src").alias("grp")).unionByName(core.select(F.col("dst").alias("grp"))).distinct()
    reach, n = core, -1
    while (m := reach.count()) != n:  # paths double in length each round
        n = m
        longer = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
        reach = saved(reach.unionByName(longer).distinct())
    mutual = reach.alias("x").join(reach.alias("y"), (F.col("x.src") == F.col("y.dst")) & (F.col("x.dst") == F.col("y.src"))).select(F.col("x.src").alias("grp"), F.col("x.dst").alias("peer"))
    top = saved(groups.join(mutual, "grp", "left").groupBy("grp").agg(F.least(F.col("grp"), F.min("peer")).alias("scc")))
    dag = saved(core.join(top.select(F.col("grp").alias("src"), F.col("scc").alias("a")), "src").join(top.select(F.col("grp").alias("dst"), F.col("scc").alias("b")), "dst").where("a <> b").select("a", "b").distinct())
    level = top.select(F.col("scc").alias("a")).distinct().withColumn("level", F.lit(0))
    for _ in range(depth - 1):
        pushed = dag.join(level, "a").select(F.col("b").alias("a"), (F.col("level") + 1).alias("level"))
        level = saved(level.unionByName(pushed).groupBy("a").agg(F.least(F.max("level"), F.lit(depth - 1)).alias("level")))
    return top.join(level.withColumnRenamed("a", "scc"), "scc").select("grp", "level")
