"""Coupling, hidden dependencies and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.bindings import bind, oracle
from tidemark.operators import coupling as ops
from tidemark.registry import query


def coupling_sql(table: str, item: str = "path_id", most: int = 30) -> str:
    """CTEs c_sets, c_revs, c_shared, c_rows, c_pairs."""
    return f""", c_sets AS (SELECT commit_id, item FROM (SELECT *, count(*) OVER (PARTITION BY commit_id) AS n FROM (SELECT DISTINCT commit_id, {item} AS item FROM {table})) WHERE n <= {most}),
    c_revs AS (SELECT item, count(*) AS revs FROM c_sets GROUP BY item),
    c_shared AS (SELECT x.item AS a, y.item AS b, count(*) AS shared_revs FROM c_sets x JOIN c_sets y ON x.commit_id = y.commit_id AND x.item < y.item GROUP BY x.item, y.item),
    c_rows AS (SELECT a, b, shared_revs, shared_revs / least(ra.revs, rb.revs)::DOUBLE AS degree, (ra.revs + rb.revs) / 2.0::DOUBLE AS avg_revs FROM c_shared JOIN c_revs ra ON ra.item = a JOIN c_revs rb ON rb.item = b
        WHERE shared_revs >= 2 AND shared_revs / least(ra.revs, rb.revs)::DOUBLE >= 0.3),
    c_pairs AS (SELECT a, b, shared_revs, degree, avg_revs, NOT ok AS low_confidence FROM c_rows, (SELECT coalesce(bool_or(shared_revs >= 5), false) AS ok FROM c_rows) WHERE shared_revs >= 5 OR NOT ok)"""


PAIRS = "SELECT a, b, shared_revs, round(degree, 6) AS degree, avg_revs, low_confidence FROM c_pairs"


def _shown(df):
    return df.select("a", "b", "shared_revs", F.round("degree", 6).alias("degree"), "avg_revs", "low_confidence")


@query(oracle("touch3", coupling_sql("touch3") + PAIRS))
def agg_coupling(spark, sf_dir):
    return _shown(ops.coupling(bind(spark, sf_dir, "touch3")))


@query(oracle("touch2", coupling_sql("touch2") + PAIRS))
def agg_coupling_large_commits(spark, sf_dir):
    return _shown(ops.coupling(bind(spark, sf_dir, "touch2")))


@query(oracle("touch2", ", s AS (SELECT commit_id, path_id, count(*) OVER (PARTITION BY commit_id) AS n FROM touch2) SELECT commit_id, path_id AS item FROM s WHERE n <= 30"))
def flt_changeset(spark, sf_dir):
    return ops.changesets(bind(spark, sf_dir, "touch2"))


@query(oracle("touch3", """, s AS (SELECT commit_id, path_id, count(*) OVER (PARTITION BY commit_id) AS n FROM touch3)
    SELECT x.commit_id, x.path_id AS a, y.path_id AS b FROM s x JOIN s y ON x.commit_id = y.commit_id AND x.path_id < y.path_id WHERE x.n <= 30"""))
def join_pair_self(spark, sf_dir):
    return ops.item_pairs(ops.changesets(bind(spark, sf_dir, "touch3")))


@query(oracle("touch2 file7", ", mods AS (SELECT DISTINCT commit_id, module FROM touch2 JOIN file7 USING (path_id))" + coupling_sql("mods", "module", 10) + PAIRS))
def agg_module_coupling(spark, sf_dir):
    modules = bind(spark, sf_dir, "file7").select("path_id", "module")
    return _shown(ops.module_coupling(bind(spark, sf_dir, "touch2").join(modules, "path_id")))


@query(oracle("touch3", coupling_sql("touch3") + "SELECT path_id, round(max(degree), 6) AS max_coupling FROM (SELECT a AS path_id, degree FROM c_pairs UNION ALL SELECT b, degree FROM c_pairs) GROUP BY 1"))
def agg_max_coupling(spark, sf_dir):
    return ops.max_coupling(ops.coupling(bind(spark, sf_dir, "touch3"))).select("path_id", F.round("max_coupling", 6).alias("max_coupling"))


HIDDEN = coupling_sql("touch2") + ", hidden AS (SELECT * FROM c_pairs WHERE NOT EXISTS (SELECT 1 FROM edge4 WHERE (src = a AND dst = b) OR (src = b AND dst = a)))"


def hidden(spark, sf_dir, coupled=None):
    return ops.hidden_dependencies(ops.coupling(bind(spark, sf_dir, "touch2")) if coupled is None else coupled, bind(spark, sf_dir, "edge4"))


@query(oracle("touch2 edge4", HIDDEN + PAIRS.replace("c_pairs", "hidden")))
def join_hidden_anti(spark, sf_dir):
    return _shown(hidden(spark, sf_dir))


@query(oracle("touch2 edge4", HIDDEN + "SELECT a, b, CASE WHEN low_confidence THEN 'low' WHEN shared_revs >= 10 THEN 'high' ELSE 'medium' END AS confidence FROM hidden"))
def prj_confidence(spark, sf_dir):
    return hidden(spark, sf_dir).select("a", "b", ops.confidence(F.col("shared_revs"), F.col("low_confidence")).alias("confidence"))


@query(oracle("touch2 edge4", HIDDEN + """SELECT 'hidden_dependency' AS category, CASE WHEN degree >= 0.65 THEN 'high' WHEN degree >= 0.45 THEN 'med' ELSE 'low' END AS severity,
    CASE WHEN low_confidence THEN 0.4::DOUBLE WHEN shared_revs >= 10 THEN 0.9::DOUBLE ELSE 0.65::DOUBLE END AS confidence, a::VARCHAR AS subject, substr(sha256('hidden_dependency:' || a || '|' || b), 1, 32) AS signature FROM hidden"""))
def fnd_hidden(spark, sf_dir):
    return ops.hidden_findings(hidden(spark, sf_dir))


@query(oracle("edge4 file7", """, grp AS (SELECT path_id, module FROM file7) SELECT least(x.module, y.module) AS a, greatest(x.module, y.module) AS b, count(*) AS edges
    FROM edge4 JOIN grp x ON src = x.path_id JOIN grp y ON dst = y.path_id WHERE x.module <> y.module GROUP BY 1, 2"""))
def gr_group_edges(spark, sf_dir):
    """Imports summed by unordered module pair."""
    from tidemark.operators import graph

    owner = bind(spark, sf_dir, "file7").select(F.col("path_id").alias("id"), F.col("module").alias("grp"))
    rows = graph.group_edges(bind(spark, sf_dir, "edge4"), owner)
    return rows.groupBy(F.least("from_group", "to_group").alias("a"), F.greatest("from_group", "to_group").alias("b")).agg(F.sum("edges").alias("edges"))


@query(oracle("touch2 edge4 file7", HIDDEN + """, g AS (SELECT path_id, module FROM file7) SELECT least(x.module, y.module) AS a, greatest(x.module, y.module) AS b, count(*) AS pairs, round(max(degree), 6) AS max_degree,
    sum(shared_revs)::BIGINT AS shared_revs FROM hidden JOIN g x ON a = x.path_id JOIN g y ON b = y.path_id WHERE x.module <> y.module GROUP BY 1, 2"""))
def dg_hidden_group(spark, sf_dir):
    g = bind(spark, sf_dir, "file7").select("path_id", "module")
    own = hidden(spark, sf_dir).join(g.select(F.col("path_id").alias("a"), F.col("module").alias("ma")), "a").join(g.select(F.col("path_id").alias("b"), F.col("module").alias("mb")), "b").where("ma <> mb")
    return own.groupBy(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).agg(F.count("*").alias("pairs"), F.round(F.max("degree"), 6).alias("max_degree"), F.sum("shared_revs").alias("shared_revs"))


@query(oracle("touch2 edge4 file7", ", mods AS (SELECT DISTINCT commit_id, module FROM touch2 JOIN file7 USING (path_id))" + coupling_sql("mods", "module", 10) + """,
    linked AS (SELECT DISTINCT least(x.module, y.module) AS a, greatest(x.module, y.module) AS b FROM edge4 JOIN file7 x ON src = x.path_id JOIN file7 y ON dst = y.path_id)
    SELECT a, b, round(degree, 6) AS degree FROM c_pairs WHERE degree >= 0.5 AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.a = c_pairs.a AND l.b = c_pairs.b)"""))
def eng_module_findings(spark, sf_dir):
    """Module pairs coupled at .5 or more that no import links."""
    g = bind(spark, sf_dir, "file7").select("path_id", "module")
    pairs = ops.module_coupling(bind(spark, sf_dir, "touch2").join(g, "path_id")).where("degree >= 0.5")
    e = bind(spark, sf_dir, "edge4").join(g.select(F.col("path_id").alias("src"), F.col("module").alias("x")), "src").join(g.select(F.col("path_id").alias("dst"), F.col("module").alias("y")), "dst")
    linked = e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.join(linked, ["a", "b"], "left_anti").select("a", "b", F.round("degree", 6).alias("degree"))
