"""Audit of how filters interact, by a subset-zeta transform.

Every document has a mask: the set of filters that it fails. Documents are counted by part and mask
once. The zeta transform (one pass a filter) turns the counts of a part into the number of documents
whose mask lies within each set of filters; those within the complement of a set survive that set.
Every order of the filters is then a walk through the sets, and each step the difference of two
neighbours. The same is done for the documents of each label.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, meet_groups, stage

#: Filters by their letters. E needs all texts and is decided by `mark`.
FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"


def zeta(counts: Column, filters: int) -> Column:
    """counts[m], one number a mask -> for each set of filters the sum over the masks within it."""
    bits = F.array(*[F.lit(1 << i) for i in range(filters)])
    within = lambda sums, bit: F.transform(sums, lambda x, m: F.when(m.bitwiseAND(bit) == 0, x).otherwise(x + F.get(sums, m - bit)))
    return F.aggregate(bits, counts, within)


def masked_counts(rows: DataFrame, filters: int, labels: list[str]) -> DataFrame:
    """part, and for all documents and each label an array of counts by mask. Rows of one part and mask meet as counts only."""
    few = rows.groupBy("part", "mask").agg(F.count("*").alias("all"), *[F.count(F.when(F.col(c), 1)).alias(c) for c in labels])
    # At most one row a mask and part is collected.
    by_mask = few.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("all", *labels).alias("n")))).alias("by_mask"))
    masks = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    at = lambda name: F.transform(masks, lambda m: F.coalesce(F.try_element_at("by_mask", m)[name], F.lit(0).cast("long")))
    return by_mask.select("part", *[at(c).alias(c) for c in ["all", *labels]])


def steps(filters: str) -> Column:
    """An array of structs, fixed by the number of filters: every step of every order, with the sets before and after it."""
    out = []
    for order in permutations(filters):
        done = 0
        for step, letter in enumerate(order, 1):
            own = 1 << filters.index(letter)
            out.append(("".join(order), step, own, done, done | own))
            done |= own
    return F.from_json(F.lit("[" + ",".join('{"o":"%s","s":%d,"f":%d,"x":%d,"y":%d}' % t for t in out) + "]"), "array<struct<o:string,s:int,f:int,x:int,y:int>>")


def interactions(rows: DataFrame, filters: str, labels: list[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, shapley, <label>_lost: every step of every order, by part.

    rows: part, mask (bit i: fails filters[i]) and a boolean column for each label. A part has all its
    rows, zeros included; an empty input has no parts. Meant for a handful of filters: 2^n counts and n!
    orders a part.
    """
    n, full = len(filters), (1 << len(filters)) - 1
    counted = masked_counts(rows, n, labels)
    whole = counted.select("part", *[zeta(F.col(c), n).alias(c) for c in ["all", *labels]])
    # survivors of a set: masks within its complement
    left = lambda name, s: F.get(F.col(name), F.lit(full) - s)
    walk = whole.select("part", "all", *labels, F.explode(steps(filters)).alias("t"))
    own, before, after = F.col("t.f"), F.col("t.x"), F.col("t.y")
    kept, removed = left("all", after), left("all", before) - left("all", after)
    fails = left("all", F.lit(0)) - left("all", own)
    found = walk.select(
        "part",
        F.col("t.o").alias("filter_order"),
        F.col("t.s").alias("step"),
        F.col("t.f").alias("filter"),
        kept.alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        (left("all", F.lit(full) - own) - left("all", F.lit(full))).alias("unique_fails"),
        *[(left(c, before) - left(c, after)).alias(f"{c}_lost") for c in labels],
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """row_id, part, mask: which of the five filters a row fails.

    A: under 200 words. B: 100 * distinct words < 50 * words. C: 100 * capitals A-Z > 2 * code points.
    D: holds any of #$%&*|. E: a row with a smaller id has the same text. Null texts count as empty, null
    parts as the empty string; a null id is neither smaller nor greater than any; rows that repeat an id
    and a text are no reason for each other to fail E.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    seen = rows.select("row_id", "part", "text", F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("kinds"))
    capitals = F.char_length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [F.col("n") < 200, 100 * F.col("kinds") < 50 * F.col("n"), 100 * capitals > 2 * F.char_length("text"), F.col("text").rlike("[#$%&*|]")]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    own = stage(seen.select("row_id", "part", bits.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-masks")
    groups = stage(own.groupBy("digest").agg(F.min("row_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"), "filter-copies")
    found = meet_groups(own, groups, "digest", "copies", how="left")
    again = F.coalesce(F.col("row_id") > F.col("first_id"), F.lit(False))
    return found.select("row_id", "part", (F.col("mask") + F.when(again, 1 << 4).otherwise(0)).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with good (quality = 1) and toxic (toxic = 1), false where the id has no label or is null.

    An id labelled more than once has what any of its labels says. Rows without an id meet no label and
    are not shuffled; rows repeating an id can hold a large share, which a join split by Spark takes.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("row_id"))
    known = known.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    some = rows.where("row_id is not null").join(known.where("good or toxic"), "row_id", "left")
    some = some.select("row_id", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return some.unionByName(rows.where("row_id is null").select("row_id", "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def op13_subset_zeta_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_labels(mark(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return interactions(rows, FILTERS, ["good", "toxic"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


QUERIES = {"op13_subset_zeta_audit": op13_subset_zeta_audit}

ORACLE_SQL = {
    "op13_subset_zeta_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        first AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
        split AS (SELECT d.doc_id, part, text, first_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d JOIN first USING (text)),
        marked AS (
            SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
                   100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, doc_id > first_id AS e
            FROM split
        ),
        labelled AS (
            SELECT part, CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 2 ELSE 0 END + CASE WHEN c THEN 4 ELSE 0 END + CASE WHEN d THEN 8 ELSE 0 END
                   + CASE WHEN e THEN 16 ELSE 0 END AS mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
            FROM marked LEFT JOIN labels ON marked.doc_id = labels.doc_id
        ),
        few AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM labelled GROUP BY part, mask),
        f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(letter, bit)),
        orders AS (
            SELECT f1.letter || f2.letter || f3.letter || f4.letter || f5.letter AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
            FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31 AND f1.bit <> f2.bit AND f1.bit <> f3.bit AND f1.bit <> f4.bit
              AND f1.bit <> f5.bit AND f2.bit <> f3.bit AND f2.bit <> f4.bit AND f2.bit <> f5.bit AND f3.bit <> f4.bit AND f3.bit <> f5.bit AND f4.bit <> f5.bit
        ),
        steps AS (
            SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS done
            FROM orders, (VALUES (1), (2), (3), (4), (5)) AS s(step)
        ),
        found AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (WHERE mask & (done | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & done = 0 AND mask & own <> 0), 0) AS removed,
                   coalesce(sum(n) FILTER (WHERE mask & done <> 0 AND mask & own <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (WHERE mask & done = 0 AND mask & own <> 0), 0) AS good_lost,
                   coalesce(sum(toxic) FILTER (WHERE mask & done = 0 AND mask & own <> 0), 0) AS toxic_lost
            FROM few, steps GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM found
    """
}
