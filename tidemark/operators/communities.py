"""Communities of a weighted graph, level by level: local moving, then contraction, until modularity no longer rises.

A graph of over ONE_TASK edges is moved and contracted by Spark; once it has no more, one task of
bounded size finds the levels that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import saved

#: Modularity must rise by this much for another round or level.
LEAST_RISE = 1e-9
#: Edges that one task takes: some 250 to 650 bytes each, the most where each has nodes of its own.
ONE_TASK = 500_000


def as_graph(weighted: DataFrame) -> DataFrame:
    """One row for each pair of ids, the smaller as src; an id's own weight is a row with src = dst."""
    return weighted.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def strengths(graph: DataFrame) -> DataFrame:
    """(id, k): the weights at each id; its own weight counts at both ends."""
    ends = graph.select(F.col("src").alias("id"), "weight").unionByName(graph.select(F.col("dst").alias("id"), "weight"))
    return ends.groupBy("id").agg(F.sum("weight").alias("k"))


def quality(graph: DataFrame, own: DataFrame, total: float, resolution: float) -> DataFrame:
    """One row: modularity of (id, k, community) and how many ids have moved since `start`."""
    ends = graph.join(own.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src").join(own.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst")
    inside = ends.agg(F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight"))), F.lit(0.0)).alias("inside"))
    degrees = own.groupBy("community").agg(F.sum("k").alias("d"), F.count(F.when(F.col("community") != F.col("start"), 1)).alias("moved"))
    degrees = degrees.agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)).alias("squares"), F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"), F.count("*").alias("communities"))
    q = F.col("inside") * 2 / F.lit(total) - F.lit(resolution) * F.col("squares") / F.lit(total * total)
    return inside.crossJoin(F.broadcast(degrees)).select(q.alias("q"), "moved", "communities")


def half_moved(both: DataFrame, own: DataFrame, total: float, resolution: float, round_no: int, half: int) -> DataFrame:
    """own after half of the ids, by a hash, went to the neighbouring community of the greatest gain.

    Ties go to staying, then to the least hash. Only half of the ids move at once, which keeps
    neighbours from swapping for ever.
    """
    sums = own.groupBy("community").agg(F.sum("k").alias("sum_k"))
    links = both.join(own.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
    stay = own.select(F.col("id").alias("src"), "community").withColumn("w", F.lit(0.0))
    options = links.unionByName(stay).groupBy("src", "community").agg(F.sum("w").alias("w")).join(sums, "community").join(own.select(F.col("id").alias("src"), "k", F.col("community").alias("now")), "src")
    same = F.col("community") == F.col("now")
    others = F.col("sum_k") - F.when(same, F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - resolution * F.col("k") * others / F.lit(total), 9)
    best = options.withColumn("gain", gain).groupBy("src").agg(F.max(F.struct("gain", same.alias("same"), (-F.xxhash64("community")).alias("h"), "community"))["community"].alias("to"))
    turn = F.pmod(F.xxhash64("id", F.lit(round_no)), F.lit(2)) == half
    return saved(own.join(best.withColumnRenamed("src", "id"), "id").select("id", "k", F.when(turn, F.col("to")).otherwise(F.col("community")).alias("community"), "start"))


def local_moving(graph: DataFrame, rounds: int, resolution: float) -> tuple[DataFrame, float, int, bool]:
    """(id -> community), modularity, number of communities, and whether it settled: the best partition of the rounds.

    Since ids move at once, a round can lose modularity; such a round is taken back, and the second
    one in a row ends the level.
    """
    both = saved(graph.where("src <> dst").select("src", "dst", "weight").unionByName(graph.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    own = saved(strengths(graph).withColumn("community", F.col("id")).withColumn("start", F.col("id")))
    total = own.agg(F.sum("k")).first()[0] or 1.0
    seen = quality(graph, own, total, resolution).first()
    best, best_q, best_n, lost = own, seen["q"], seen["communities"], 0
    for no in range(rounds):
        own = best.withColumn("start", F.col("community"))
        for half in (0, 1):
            own = half_moved(both, own, total, resolution, no, half)
        seen = quality(graph, own, total, resolution).first()
        if not seen["moved"]:
            return best, best_q, best_n, True
        if seen["q"] > best_q + LEAST_RISE:
            best, best_q, best_n, lost = own, seen["q"], seen["communities"], 0
        elif (lost := lost + 1) == 2:
            return best, best_q, best_n, True
    return best, best_q, best_n, False


def contracted(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph of communities: weights between them summed, what lies within one as its own weight."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    return as_graph(graph.join(a, "src").join(b, "dst").select(F.col("ca").alias("src"), F.col("cb").alias("dst"), "weight"))


def moved_in_turn(at: np.ndarray, to: np.ndarray, weight: np.ndarray, k: np.ndarray, total: float, rounds: int, resolution: float) -> tuple[np.ndarray, bool]:
    """The community of each node, and whether a round moved none: nodes go one after another to where modularity gains most.

    Neighbours of node i are to[at[i]:at[i + 1]], without i itself. Ties go to staying, then to the
    community of the smallest neighbour. No move loses modularity, as each one sees those before it.
    """
    n, k = len(k), k.tolist()
    nodes = [(to[a:b].tolist(), weight[a:b].tolist()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    own, sums = list(range(n)), list(k)
    for _ in range(rounds):
        moved = False
        for i, (near, weights) in enumerate(nodes):
            links = {}
            for j, w in zip(near, weights):
                links[own[j]] = links.get(own[j], 0.0) + w
            now, share = own[i], resolution * k[i] / total
            sums[now] -= k[i]
            best, best_gain = now, links.get(now, 0.0) - share * sums[now] + LEAST_RISE
            for c, w in links.items():
                if w - share * sums[c] > best_gain:
                    best, best_gain = c, w - share * sums[c] + LEAST_RISE
            sums[best] += k[i]
            if best != now:
                own[i], moved = best, True
        if not moved:
            return np.array(own, np.int64), True
    return np.array(own, np.int64), False


def levels_in_one_task(ids: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, resolution: float, rounds: int, first: int, most_levels: int, last: float | None) -> Iterator[tuple[np.ndarray, int, float, bool]]:
    """(name of each id's community, communities, modularity, settled) of each level from `first` on, while it exceeds `last`.

    a and b are places in the sorted ids; edges are distinct pairs, in order. Communities are numbered by their smallest id.
    """
    label = np.arange(len(ids))
    for _ in range(first, most_levels + 1):
        n = int(label.max()) + 1
        k = np.bincount(a, weight, n) + np.bincount(b, weight, n)
        total = float(k.sum()) or 1.0
        apart = a != b
        src, dst, w = np.concatenate([a[apart], b[apart]]), np.concatenate([b[apart], a[apart]]), np.concatenate([weight[apart]] * 2)
        order = np.lexsort((dst, src))
        at = np.searchsorted(src[order], np.arange(n + 1))
        own, settled = moved_in_turn(at, dst[order], w[order], k, total, rounds, resolution)
        degrees = np.bincount(own, k, n)
        q = 2 * float(weight[own[a] == own[b]].sum()) / total - resolution * float(degrees @ degrees) / (total * total)
        if last is not None and q <= last + LEAST_RISE:
            return
        last = q
        _, smallest, number = np.unique(own, return_index=True, return_inverse=True)
        number = np.argsort(np.argsort(smallest))[number]
        label = number[label]
        names = ids[np.unique(label, return_index=True)[1]]
        yield names[label], len(smallest), q, settled
        pair, edge = np.unique(np.minimum(number[a], number[b]) * len(smallest) + np.maximum(number[a], number[b]), return_inverse=True)
        a, b, weight = pair // len(smallest), pair % len(smallest), np.bincount(edge, weight)


def few_edges(graph: DataFrame, resolution: float, rounds: int, first: int, most_levels: int, last: float | None) -> tuple[DataFrame, list[tuple[int, int, float, bool]]]:
    """(id, level, community) and the rows of community_levels' second table, of a graph of at most ONE_TASK edges."""
    kind = graph.schema["src"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [x for x in batches if x.num_rows]
        if not edges:
            return
        edges = pa.Table.from_batches(edges)
        id_type = edges.schema.field("src").type
        src, dst, weight = (edges.column(c).to_numpy() for c in ("src", "dst", "weight"))
        ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = place[: len(src)], place[len(src) :]
        order = np.lexsort((b, a))
        levels = levels_in_one_task(ids, a[order], b[order], weight[order], resolution, rounds, first, most_levels, last)
        types = [("id", id_type), ("level", pa.int32()), ("community", id_type), ("communities", pa.int64()), ("modularity", pa.float64()), ("settled", pa.bool_())]
        for level, (names, *figures) in enumerate(levels, first):
            for low in range(0, len(ids), 1 << 16):
                own, named = ids[low : low + (1 << 16)], names[low : low + (1 << 16)]
                none = [None] * len(own)
                yield pa.RecordBatch.from_pydict(dict(zip(dict(types), (own, [level] * len(own), named, none, none, none))), pa.schema(types))
            yield pa.RecordBatch.from_pydict(dict(zip(dict(types), ([x] for x in (None, level, None, *figures)))), pa.schema(types))

    rows = saved(graph.where("src is not null").coalesce(1).mapInArrow(found, f"id {kind}, level int, community {kind}, communities long, modularity double, settled boolean"))
    # One row a level.
    levels = rows.where("id is null").select("level", "communities", "modularity", "settled").orderBy("level").collect()
    return rows.where("id is not null").select("id", "level", "community"), [tuple(r) for r in levels]


def community_levels(weighted: DataFrame, resolution: float = 1.0, rounds: int = 12, most_levels: int = 10, one_task: int = ONE_TASK) -> tuple[DataFrame, DataFrame]:
    """(members, levels) of the undirected graph weighted (src, dst, weight).

    members: id, level, community, for every level; a community is named by its smallest id. levels:
    level, communities, modularity, settled. Level 1 moves ids; each further level moves the
    communities of the last one, as long as modularity rises. settled is false where a level used up
    its rounds while ids still moved; the last level is settled only if no further level rises. The
    same input gives the same result. Ids without an edge are in no community. Levels of over
    `one_task` edges are found by local_moving, those of fewer by moved_in_turn.
    """
    graph, level_of, members, levels, rises = saved(as_graph(weighted)), None, None, [], True
    while (edges := graph.count()) > one_task and len(levels) < most_levels:
        labels, q, n, settled = local_moving(graph, rounds, resolution)
        if levels and q <= levels[-1][2] + LEAST_RISE:
            rises = False
            break
        names = labels.groupBy("community").agg(F.min("id").alias("name"))
        labels = saved(labels.join(names, "community").select("id", F.col("name").alias("community")))
        level_of = labels if level_of is None else saved(level_of.join(labels.toDF("community", "upper"), "community").select("id", F.col("upper").alias("community")))
        levels.append((len(levels) + 1, n, float(q), settled))
        named = level_of.select("id", F.lit(len(levels)).alias("level"), "community")
        members = named if members is None else members.unionByName(named)
        graph = saved(contracted(graph, labels))
    if rises and edges <= one_task:
        rest, more = few_edges(graph, resolution, rounds, len(levels) + 1, most_levels, levels[-1][2] if levels else None)
        if level_of is not None:
            rest = level_of.join(rest.toDF("community", "level", "upper"), "community").select("id", "level", F.col("upper").alias("community"))
        members, levels = rest if members is None else members.unionByName(rest), levels + more
    if not levels:
        levels = [(1, 0, 0.0, True)]
    elif rises and len(levels) == most_levels:
        levels[-1] = (*levels[-1][:3], False)
    return saved(members), weighted.sparkSession.createDataFrame(levels, "level int, communities long, modularity double, settled boolean")


def communities(weighted: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community) of the last level."""
    members, levels = community_levels(weighted, resolution)
    return members.join(F.broadcast(levels.agg(F.max("level").alias("level"))), "level").select("id", "community")
