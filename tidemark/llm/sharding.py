"""Shards by a K-d tree over document metadata.

Copies of one text are placed as one item (cut into pieces where they outweigh an eighth of a
shard). The tree splits the items at distributed weighted medians along the dimension that is widest
in the node, in proportion to the leaves each side must have, until every leaf is one shard of the
target size. One row per open node and pass reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, free, prefix_sums, stage

#: A coordinate has COORD bits; below it HASH bits of the item's hash order items that share it.
COORD, HASH, BINS = 24, 38, 1024


@dataclass
class Node:
    """An open node: its id is that of its first shard."""

    first: int
    leaves: int
    total: int = 0
    dim: int = 0
    lo: int = 0
    hi: int = 0
    below: int = 0  # weight before lo
    cut: int | None = None

    @property
    def want(self) -> float:
        """The weight of the left side."""
        return self.total * (self.leaves // 2) / self.leaves

    @property
    def width(self) -> int:
        return -(-(self.hi - self.lo + 1) // BINS)


def _with(items: DataFrame, rows: list[tuple], columns: tuple[str, ...], how: str = "inner") -> DataFrame:
    """items with a table of the open nodes: at most as many rows as there are shards, so it is broadcast."""
    values = ", ".join(f"({', '.join(map(str, r))})" for r in rows)
    table = items.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
    return items.join(F.broadcast(table), "node", how)


def _key(dims: int) -> Column:
    """The coordinate along the node's dimension, then the item's hash."""
    return F.shiftleft(F.get(F.array(*[F.col(f"d{i}") for i in range(dims)]), F.col("dim")), HASH).bitwiseOR(F.col("low"))


def _refine(n: Node, found, tolerance: float) -> None:
    """Narrow the node's range to the keys of the bin that holds its median (found), or set its cut."""
    if found is None:
        n.cut = n.hi
        return
    n.below += found["before"]
    n.lo, n.hi, w = found["least"], found["most"], found["w"]
    if n.lo == n.hi or w <= tolerance * n.total / n.leaves:
        # The nearer side of the bin.
        n.cut = n.hi if n.want - n.below > n.below + w - n.want else n.lo - 1


def kd_leaves(items: DataFrame, shards: int, dims: int, tolerance: float = 0.001) -> DataFrame:
    """items with `node`, the shard of each: d0..d(dims-1) (coordinates below 2^24), low (hash below 2^38), weight.

    Every level splits all open nodes in the same jobs: one for their widths, and a few histograms,
    each narrowing every median to the keys of one of BINS bins, until that bin weighs less than `tolerance` of a
    shard or is a single key. The bin is found in Spark, among at most BINS rows a node: one row for
    each open node reaches the driver. Each level is written, so that its jobs read one small table.
    """
    at, nodes, spans = items.withColumn("node", F.lit(0)), [Node(0, shards)], None
    ends = [f(f"d{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    while nodes := [n for n in nodes if n.leaves > 1]:
        stats = {r["node"]: r for r in _with(at, [(n.first,) for n in nodes], ("node",)).groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect()}
        spans = spans or [max(1, stats[0][f"hi{i}"] - stats[0][f"lo{i}"]) if stats else 1 for i in range(dims)]
        for n in nodes:
            if s := stats.get(n.first):
                n.total, n.dim = s["w"], max(range(dims), key=lambda i: ((s[f"hi{i}"] - s[f"lo{i}"]) / spans[i], -i))
                n.lo, n.hi = s[f"lo{n.dim}"] << HASH, ((s[f"hi{n.dim}"] + 1) << HASH) - 1
            else:
                n.cut = 0
        while live := [n for n in nodes if n.cut is None]:
            inside = _with(at, [(n.first, n.dim, n.lo, n.hi, n.width) for n in live], ("node", "dim", "lo", "hi", "width")).withColumn("key", _key(dims))
            bins = inside.where("key between lo and hi").groupBy("node", F.expr("(key - lo) div width").alias("bin")).agg(F.sum("weight").alias("w"), F.min("key").alias("least"), F.max("key").alias("most"))
            upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
            placed = _with(bins.withColumn("before", upto - F.col("w")), [(n.first, n.want - n.below) for n in live], ("node", "want"))
            seen = {r["node"]: r for r in placed.where("before < want and before + w >= want").collect()}
            for n in live:
                _refine(n, seen.get(n.first), tolerance)
        cut = _with(at, [(n.first, n.dim, n.cut, n.first + n.leaves // 2) for n in nodes], ("node", "dim", "cut", "right"), "left")
        before, at = at, stage(cut.withColumn("node", F.when(_key(dims) > F.col("cut"), F.col("right")).otherwise(F.col("node"))).drop("dim", "cut", "right"), "shard-level")
        free(before)
        nodes = [x for n in nodes for x in (Node(n.first, n.leaves // 2), Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2))]
    return at


def kd_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang"), overhead: int = 16) -> DataFrame:
    """row_id, size, text_crc32, shard, slot for every row; shards are near equal in bytes.

    The dimensions are the logarithm of the text's bytes and a hash of each metadata column (of the
    copy with the smallest id, so that copies stay together). Sizes are UTF-8 bytes plus `overhead`.
    Null texts count as empty; null metadata is a value like any other; null ids sort first; repeated
    rows count each; an empty input gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(F.col(id_col).alias("row_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("grp"), *[F.shiftrightunsigned(F.xxhash64(F.col(c).cast("string")), 64 - COORD).alias(f"m{i}") for i, c in enumerate(metadata)]),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1, total // (shards * 8))
    # At most 8 items a shard can weigh that much, so this table has a fixed bound.
    heavy = rows.groupBy("grp").agg(F.sum("size").alias("w")).where(F.col("w") > most).select("grp", F.ceil(F.col("w") / most).alias("pieces"))
    rows = stage(rows.join(F.broadcast(heavy), "grp", "left").withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(1), "row_id"), F.col("pieces"))).cast("int")).drop("pieces"), "shard-pieces")
    names = [f"m{i}" for i in range(len(metadata))]
    first = F.min(F.struct("row_id", "size", *names)).alias("first")
    items = rows.groupBy("grp", "piece").agg(F.sum("size").alias("weight"), first)
    size_coord = F.least(F.floor(F.log2(F.col("first.size").cast("double")) * F.lit(float(1 << (COORD - 6)))), F.lit((1 << COORD) - 1)).cast("long")
    low = F.shiftrightunsigned(F.xxhash64("grp", "piece"), 64 - HASH)
    items = stage(items.select("grp", "piece", "weight", low.alias("low"), size_coord.alias("d0"), *[F.col(f"first.{n}").alias(f"d{i + 1}") for i, n in enumerate(names)]), "shard-items")
    places = stage(kd_leaves(items, shards, len(names) + 1).select("grp", "piece", F.col("node").alias("shard")), "shard-places")
    placed = stage(rows.join(places, ["grp", "piece"]).select("row_id", "size", "text_crc32", "shard", F.xxhash64(F.lit(2), "row_id", "grp").alias("h")), "shard-placed")
    return prefix_sums(placed, ["shard"], "h", ["row_id"], "size").select("row_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kd_shards(documents(spark, sf_dir), 40)
    return found.select(F.col("row_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_kd_sharding": op1_kd_sharding}
