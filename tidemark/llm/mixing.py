"""Temperature mixing of sources, with DataFrame and SQL functions only.

Token shares p_i are raised to an exponent and normalised: w_i = p_i^a / sum p^a, with a in [0, 1]
(1: as the corpus is, 0: all sources alike). The exponent is bisected to the smallest one that keeps
every source within `max_repeats` passes, or to the one whose weights have a given entropy. The
weights are realised as blocks of `block_tokens`: each source's documents are permuted by a keyed
hash, pass after pass, and block b takes the b-th piece of weight w_i of every source's permutation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, prefix_sums, stage

#: Exponents tried in one job: four halvings of the interval at a time.
STEPS = 16


@dataclass(frozen=True)
class Mix:
    """Target: max_repeats (the most passes over a source, in tokens), or target_entropy in nats."""

    max_repeats: float = 2.0
    target_entropy: float | None = None
    block_tokens: int = 1 << 20
    seed: int = 7
    rounds: int = 6


def estimated_tokens(text: Column) -> Column:
    """Four UTF-8 bytes a token, one token at least; null counts as empty."""
    return F.greatest(F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4), F.lit(1)).cast("long")


def source_name(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit("(none)"))


def shares(rows: DataFrame) -> DataFrame:
    """rows (src, tokens) -> src, src_tokens, share: one row per source."""
    sums = rows.groupBy("src").agg(F.sum("tokens").alias("src_tokens"))
    total = sums.agg(F.sum("src_tokens").alias("all_tokens"))
    return sums.crossJoin(F.broadcast(total)).select("src", "src_tokens", (F.col("src_tokens") / F.col("all_tokens")).alias("share"))


def find_exponent(spread: DataFrame, mix: Mix) -> float:
    """Bisect the exponent. Each job tries the interior points of STEPS equal parts of the interval.

    As the exponent grows, entropy falls and so does the number of passes that the smallest sources
    need when every document is used at least once, so both targets have one crossing.
    """
    lo, hi = 0.0, 1.0
    for _ in range(mix.rounds):
        tried = F.explode(F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.lit(lo) + (F.lit(hi) - F.lit(lo)) * i / STEPS))
        each = spread.select("share", tried.alias("a")).withColumn("u", F.pow("share", "a"))
        # The passes a source needs are in proportion to w_i / p_i = p_i^(a-1) / sum: most over least.
        seen = each.groupBy("a").agg(
            F.sum("u").alias("z"), F.sum(F.col("u") * F.log("u")).alias("ulogu"), (F.max(F.pow("share", F.col("a") - 1)) / F.min(F.pow("share", F.col("a") - 1))).alias("passes")
        )
        seen = seen.withColumn("entropy", F.log("z") - F.col("ulogu") / F.col("z"))
        good = F.col("entropy") >= mix.target_entropy if mix.target_entropy is not None else F.col("passes") > mix.max_repeats
        edge = seen.agg(F.max(F.when(good, F.col("a"))).alias("lo"), F.min(F.when(~good, F.col("a"))).alias("hi")).first()
        if edge["lo"] is None:
            return lo if edge["hi"] is None else edge["hi"]
        if edge["hi"] is None:
            return edge["lo"]
        lo, hi = edge["lo"], edge["hi"]
    # Entropy holds at lo, the limit on passes at hi.
    return lo if mix.target_entropy is not None else hi


def weights(rows: DataFrame, mix: Mix) -> DataFrame:
    """src, src_tokens, share, weight, budget: the tokens each source gives to the mix.

    The whole mix is the smallest that uses every document at least once at these weights, so no
    source is cut; the others are repeated.
    """
    spread = stage(shares(rows), "mix-shares")
    a = find_exponent(spread, mix)
    raised = spread.withColumn("u", F.pow("share", F.lit(a)))
    whole = raised.agg(F.sum("u").alias("z"), F.max(F.col("src_tokens") / F.col("u")).alias("per_u"))
    return raised.crossJoin(F.broadcast(whole)).select(
        "src", "src_tokens", "share", F.lit(a).alias("exponent"), (F.col("u") / F.col("z")).alias("weight"), F.greatest(F.round(F.col("u") * F.col("per_u")), F.col("src_tokens").cast("double")).cast("long").alias("budget")
    )


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs with a column that tells rows of one id apart, and its name.

    Where every row has an id of its own it is 0; else docs are written once with a number for each row,
    so that all that is derived from them agrees.
    """
    (no,) = fresh(docs, "no")
    repeated = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null")
    if repeated.isEmpty():
        return docs.withColumn(no, F.lit(0).cast("long")), no
    return stage(docs.withColumn(no, F.monotonically_increasing_id()), "mix-numbered"), no


def row_key(id_col: str, no: str) -> Column:
    """What a row's place in a permutation is drawn from."""
    return F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(no))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, no: str) -> DataFrame:
    key = row_key(id_col, no).alias("key")
    return stage(docs.select(F.col(id_col).alias("row_id"), source_name(F.col(source_col)).alias("src"), estimated_tokens(F.col(text_col)).alias("tokens"), key), "mix-rows")


def plan_mix(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(placed, weights). placed: row_id, src, tokens, pass, start, block for every use of a document.

    A document's first use is in pass 0. A source's last pass takes the documents whose start in that
    pass's permutation lies before the rest of the budget. start counts the source's tokens before it.
    Null sources form the source "(none)"; rows that repeat an id, or have none, are documents of their
    own with places of their own; an empty input gives empty tables. All passes are placed in one job,
    and the rows of the result are all that grows with their number.
    """
    own, no = numbered(docs, id_col)
    rows = sized(own, id_col, text_col, source_col, no)
    found = stage(weights(rows, mix), "mix-weights")
    passes = F.ceil(F.col("budget") / F.col("src_tokens")).cast("int")
    each = found.select("src", "src_tokens", "budget", F.explode(F.sequence(F.lit(0), passes - 1)).alias("pass"))
    needed = each.select("src", "pass", (F.col("src_tokens") * F.col("pass")).alias("passed"), (F.col("budget") - F.col("src_tokens") * F.col("pass")).alias("rest"))
    part = rows.join(needed, "src").withColumn("h", F.xxhash64(F.lit(mix.seed), "pass", "key"))
    uses = prefix_sums(stage(part, "mix-uses"), ["src", "pass"], "h", ["key", "tokens"], "tokens").where("before < rest").withColumn("start", F.col("before") + F.col("passed"))
    block = F.floor(F.col("start") / F.greatest(F.col("weight") * mix.block_tokens, F.lit(1.0))).cast("long")
    return uses.join(found.select("src", "weight"), "src").select("row_id", "src", "tokens", "pass", "start", block.alias("block"), "weight"), found


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix that plan_mix plans, with all their columns: each once, and again for each further pass.

    How often a document is used is decided row by row: the last pass of a source takes the documents
    up to that source's cut, a hash and the row's key, so the texts themselves are not shuffled where
    Spark broadcasts the plan, one row a source, by its own limit of size; beyond that it deals both
    sides by source and splits the hot ones.
    """
    own, no = numbered(docs, id_col)
    rows = sized(own, id_col, text_col, source_col, no)
    found = stage(weights(rows, mix).withColumn("full", F.floor(F.col("budget") / F.col("src_tokens")).cast("int")), "mix-weights")
    last = rows.join(found.select("src", "full", (F.col("budget") - F.col("full") * F.col("src_tokens")).alias("rest")), "src")
    last = stage(last.select("src", "tokens", "key", "rest", F.xxhash64(F.lit(mix.seed), "full", "key").alias("h")), "mix-last")
    cuts = prefix_sums(last, ["src"], "h", ["key", "tokens"], "tokens").where("before < rest").groupBy("src").agg(F.max(F.struct("h", "key")).alias("cut"))
    src, full, cut, use = fresh(own, "src", "full", "cut", "use")
    plan = stage(found.join(cuts, "src", "left").select(F.col("src").alias(src), F.col("full").alias(full), F.col("cut").alias(cut)), "mix-plan")
    place = F.struct(F.xxhash64(F.lit(mix.seed), F.col(full), row_key(id_col, no)).alias("h"), row_key(id_col, no).alias("key"))
    times = F.col(full) + F.when(place <= F.col(cut), 1).otherwise(0)
    return own.withColumn(src, source_name(F.col(source_col))).join(plan, src).withColumn(use, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = plan_mix(documents(spark, sf_dir), Mix())
    return placed.select(F.col("row_id").alias("doc_id"), F.col("src").alias("source"), "tokens", "pass", "start", "block", "weight")


QUERIES = {"op9_temperature_mixing": op9_temperature_mixing}
