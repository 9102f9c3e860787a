"""Breakpoints of a corpus: which cell a value is read against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a cell stands for others from so many repositories on.
LEAST_REPOS = 5


def widened(cells: DataFrame, wanted: DataFrame, least: int = LEAST_REPOS) -> DataFrame:
    """wanted (language, bucket and more) with the breakpoints of the narrowest cell that enough repositories back.

    First the cell itself, then the best backed one of its language, then the best backed of all; provenance
    says which (null where none is). cells: language, bucket, n_repos and breakpoints, few rows: the
    best of each level are looked up by joins on the level's keys.
    """
    values = [c for c in cells.columns if c not in ("language", "bucket")]
    enough = cells.where(F.col("n_repos") >= least)
    best = lambda by, name: enough.groupBy(*by).agg(F.max_by(F.struct(*values), F.struct("n_repos", "language", "bucket")).alias(name))
    rows = wanted.join(best(["language", "bucket"], "cell"), ["language", "bucket"], "left").join(best(["language"], "wide"), "language", "left").crossJoin(F.broadcast(best([], "any")))
    level = F.when(F.col("cell").isNotNull(), "cell").when(F.col("wide").isNotNull(), "language").when(F.col("any").isNotNull(), "corpus")
    chosen = F.coalesce("cell", "wide", "any")
    return rows.select(*wanted.columns, level.alias("provenance"), *[chosen[c].alias(c) for c in values])


def percentile_of(value: Column, values: list[str], fractions: list[float]) -> Column:
    """Piecewise linear through a row's own breakpoints (columns `values`), clamped at both ends."""
    cols = [F.col(v) for v in values]
    out = F.when(cols[0].isNull() | value.isNull(), F.lit(None).cast("double")).when(value <= cols[0], fractions[0])
    for (v0, p0), (v1, p1) in zip(zip(cols, fractions, strict=True), zip(cols[1:], fractions[1:], strict=True), strict=False):
        out = out.when((v1 > v0) & (value <= v1), p0 + (value - v0) / (v1 - v0) * (p1 - p0))
    return out.otherwise(fractions[-1])


def as_json(cells: DataFrame) -> DataFrame:
    """One JSON text a cell, its keys in the order of the columns."""
    return cells.select(F.to_json(F.struct(*cells.columns)).alias("json"))


def mermaid(links: DataFrame, most: int = 25_000) -> DataFrame:
    """(line_no, line) of a flow chart of group edges (from_group, to_group, edges): the `most` heaviest, ties by name.

    The lines are numbered by one window over at most `most` rows.
    """
    top = links.orderBy(F.desc("edges"), "from_group", "to_group").limit(most)
    name = lambda c: F.concat(F.lit("g_"), F.regexp_replace(F.col(c).cast("string"), r"[^A-Za-z0-9]", "_"))
    line = F.concat(F.lit("  "), name("from_group"), F.lit(" -->|"), F.col("edges").cast("string"), F.lit("| "), name("to_group"))
    rows = top.select(F.row_number().over(Window.orderBy(F.desc("edges"), "from_group", "to_group")).alias("line_no"), line.alias("line"))
    return rows.sparkSession.createDataFrame([(0, "flowchart LR")], "line_no int, line string").unionByName(rows)
