"""Graph operators on import edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.bindings import bind, oracle
from tidemark.operators import communities, coupling, cycles, folders, graph
from tidemark.plans.history import CYCLES
from tidemark.plans.links import coupling_sql, hidden
from tidemark.plans.paths import LAYER
from tidemark.registry import query


def _edges(spark, sf_dir):
    return bind(spark, sf_dir, "edge4")


@query(oracle("edge4", "SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edge4 UNION ALL SELECT dst, 0, 1 FROM edge4) GROUP BY 1"))
def gr_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(oracle("edge4", "SELECT src AS id, count(*) AS out_degree FROM edge4 WHERE src NOT IN (SELECT dst FROM edge4) GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 10"))
def gr_inferred_entries(spark, sf_dir):
    """Over all edges, where every file may be imported by some other."""
    return graph.inferred_entries(_edges(spark, sf_dir)).select("id", "out_degree")


@query(oracle("edge4 file7", f""", l AS (SELECT path_id, path, {LAYER} AS layer FROM file7), r AS (SELECT x.path AS src, y.path AS dst, x.layer AS from_layer, y.layer AS to_layer FROM edge4 JOIN l x ON src = x.path_id JOIN l y ON dst = y.path_id),
    o AS (SELECT *, list_position(['ui', 'service', 'db'], from_layer) AS f, list_position(['ui', 'service', 'db'], to_layer) AS t FROM r)
    SELECT src, dst, from_layer, to_layer, CASE WHEN f = 1 AND t = 3 THEN 'skip' ELSE 'inverted' END AS kind FROM o WHERE (f = 1 AND t = 3) OR f > t"""))
def gr_layering(spark, sf_dir):
    names = bind(spark, sf_dir, "file7").select("path_id", "path")
    e = _edges(spark, sf_dir).join(names.select(F.col("path_id").alias("src"), F.col("path").alias("a")), "src").join(names.select(F.col("path_id").alias("dst"), F.col("path").alias("b")), "dst")
    return graph.layering(e.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def bfs_sql(step: str, start: str, depth: int | str) -> str:
    return f", b AS (SELECT id, 0 AS hops FROM ({start}) UNION SELECT e.id, hops + 1 FROM b JOIN ({step}) e ON e.at = b.id WHERE hops < {depth}) SELECT id, min(hops) AS hops FROM b GROUP BY 1"


@query(oracle("edge4", bfs_sql("SELECT dst AS at, src AS id FROM edge4", "SELECT 7::BIGINT AS id", 6)))
def gr_bfs_reverse(spark, sf_dir):
    """Everything that imports file 7, to depth 6."""
    return graph.bfs(_edges(spark, sf_dir), spark.createDataFrame([(7,)], "id long"), 6, reverse=True)


@query(oracle("edge4", bfs_sql("SELECT src AS at, dst AS id FROM edge4", "SELECT 1::BIGINT AS id UNION ALL SELECT 2::BIGINT", "(SELECT count(DISTINCT src) FROM edge4)")))
def gr_bfs_layers(spark, sf_dir):
    """Hops from files 1 and 2, however far; the SQL stops at as many hops as there are files."""
    return graph.bfs(_edges(spark, sf_dir), spark.createDataFrame([(1,), (2,)], "id long"), None)


@query(oracle("edge4", bfs_sql("SELECT src AS at, dst AS id FROM edge4", "SELECT 1::BIGINT AS id", 12).replace("SELECT id, min(hops) AS hops FROM b GROUP BY 1", "SELECT min(hops) + 1 AS files FROM b WHERE id = 9")))
def gr_path(spark, sf_dir):
    """Files on the shortest import path from 1 to 9."""
    return graph.shortest_path(_edges(spark, sf_dir), F.lit(1).cast("long"), F.lit(9).cast("long")).select(F.size("path").alias("files"))


@query(oracle("edge4", """, u AS (SELECT src AS a, dst AS b FROM edge4 UNION SELECT dst, src FROM edge4),
    r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS id, least(a, min(b)) AS label FROM r GROUP BY a"""))
def gr_components(spark, sf_dir):
    return graph.connected_components(_edges(spark, sf_dir))


@query(oracle("edge4", CYCLES + "SELECT * FROM c"))
def gr_cycles(spark, sf_dir):
    """All simple cycles of up to ten files."""
    return cycles.all_cycles(_edges(spark, sf_dir))


@query(oracle("edge4", """, r AS (SELECT src AS a, dst AS b FROM edge4 UNION SELECT r.a, e.dst FROM r JOIN edge4 e ON r.b = e.src)
    SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1"""))
def gr_strong_components(spark, sf_dir):
    """Files on a cycle with the smallest file of their strong component."""
    return cycles.strong_components(_edges(spark, sf_dir))


ARCH = CYCLES + f""", t AS (SELECT * FROM c ORDER BY size DESC, members LIMIT 50),
    l AS (SELECT path_id, path, {LAYER} AS layer FROM file7), r AS (SELECT x.path_id AS src, y.path_id AS dst, list_position(['ui', 'service', 'db'], x.layer) AS f, list_position(['ui', 'service', 'db'], y.layer) AS t FROM edge4 JOIN l x ON src = x.path_id JOIN l y ON dst = y.path_id),
    v AS (SELECT CASE WHEN f = 1 AND t = 3 THEN 'skip' ELSE 'inverted' END AS kind, src, dst FROM r WHERE (f = 1 AND t = 3) OR f > t),
    a AS (SELECT 'cycle' AS kind, CASE WHEN size >= 5 THEN 'high' WHEN size >= 3 THEN 'med' ELSE 'low' END AS severity, 1.0::DOUBLE AS confidence, members[1] AS path_id, size, substr(sha256('architecture:' || array_to_string(list_sort(list_transform(members, lambda x: x::VARCHAR)), '|')), 1, 32) AS signature FROM t
        UNION ALL SELECT kind, CASE kind WHEN 'skip' THEN 'high' ELSE 'med' END, 0.75, src, 1, substr(sha256('architecture:' || kind || '|' || src || '|' || dst), 1, 32) FROM v)"""


@query(oracle("edge4 file7", ARCH + "SELECT * FROM a"))
def fnd_arch(spark, sf_dir):
    """The fifty longest cycles and all layering violations, with severity and confidence."""
    names = bind(spark, sf_dir, "file7").select("path_id", "path")
    e = _edges(spark, sf_dir).join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    bad = graph.layering(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("src").alias("from_id"), F.col("dst").alias("to_id"))).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "kind")
    return graph.architecture_findings(cycles.best_cycles(_edges(spark, sf_dir)), bad)


def _weights(spark, sf_dir):
    return graph.graph_weights(_edges(spark, sf_dir), coupling.coupling(bind(spark, sf_dir, "touch2")))


WEIGHTS = coupling_sql("touch2") + """, w AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, 1.0::DOUBLE AS weight FROM edge4 UNION ALL SELECT a, b, 1.5::DOUBLE * degree FROM c_pairs) GROUP BY 1, 2)"""


@query(oracle("touch2 edge4", WEIGHTS + "SELECT src, dst, round(weight, 6) AS weight FROM w"))
def gr_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select("src", "dst", F.round("weight", 6).alias("weight"))


def pagerank_sql(rounds: int) -> str:
    """So many rounds that six digits no longer change."""
    out = """, s AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, weight FROM w UNION ALL SELECT dst, src, weight FROM w)),
        ids AS MATERIALIZED (SELECT DISTINCT src AS id FROM s), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS rank FROM ids)"""
    for i in range(rounds):
        out += f", r{i + 1} AS MATERIALIZED (SELECT ids.id, 0.15::DOUBLE / (SELECT count(*) FROM ids) + 0.85::DOUBLE * coalesce(sum(r.rank * s.p), 0) AS rank FROM ids LEFT JOIN s ON s.dst = ids.id LEFT JOIN r{i} r ON r.id = s.src GROUP BY ids.id)"
    return out + f" SELECT id, round(rank, 6) AS rank FROM r{rounds}"


@query(oracle("touch2 edge4", WEIGHTS + pagerank_sql(60)))
def gr_pagerank(spark, sf_dir):
    return graph.pagerank(_weights(spark, sf_dir), tolerance=1e-10).select("id", F.round("rank", 6).alias("rank"))


def _members(spark, sf_dir):
    return _edges(spark, sf_dir).select(F.col("src").alias("id"), (F.col("src") % 5).alias("community")).distinct()


@query(oracle("touch2 edge4", WEIGHTS + """, e AS (SELECT src % 5 AS a, dst % 5 AS b, weight FROM w), m AS (SELECT sum(weight) AS m FROM e), d AS (SELECT c, sum(weight) AS deg FROM (SELECT a AS c, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY 1),
    i AS (SELECT a AS c, sum(weight) AS inw FROM e WHERE a = b GROUP BY 1) SELECT round(sum(coalesce(inw, 0) / m - pow(deg / (2 * m), 2)), 6) AS modularity FROM d LEFT JOIN i USING (c), m"""))
def gr_modularity(spark, sf_dir):
    return graph.modularity(_weights(spark, sf_dir), _members(spark, sf_dir)).select(F.round("modularity", 6).alias("modularity"))


@query(oracle("edge4", """, e AS (SELECT src % 5 AS a, dst % 5 AS b FROM edge4), x AS (SELECT c, sum(i) AS i, sum(o) AS o FROM (SELECT a AS c, 1 AS i, 0 AS o FROM e WHERE a = b UNION ALL SELECT a, 0, 1 FROM e WHERE a <> b UNION ALL SELECT b, 0, 1 FROM e WHERE a <> b) GROUP BY 1)
    SELECT g AS community, files, round(coalesce(i / (i + o), 0), 6)::DOUBLE AS cohesion FROM (SELECT src % 5 AS g, count(DISTINCT src) AS files FROM edge4 GROUP BY 1) LEFT JOIN x ON c = g"""))
def gr_cohesion(spark, sf_dir):
    return graph.cohesion(_edges(spark, sf_dir), _members(spark, sf_dir)).select("community", "files", F.round("cohesion", 6).alias("cohesion"))


@query(oracle("edge4", """, e AS (SELECT src % 5 AS a, dst % 5 AS b FROM edge4), x AS (SELECT c, sum(i) AS i, sum(o) AS o FROM (SELECT a AS c, 1 AS i, 0 AS o FROM e WHERE a = b UNION ALL SELECT a, 0, 1 FROM e WHERE a <> b UNION ALL SELECT b, 0, 1 FROM e WHERE a <> b) GROUP BY 1),
    s AS (SELECT g AS community, files, coalesce(i / (i + o), 0) AS cohesion, files / sum(files) OVER () AS share FROM (SELECT src % 5 AS g, count(DISTINCT src) AS files FROM edge4 GROUP BY 1) LEFT JOIN x ON c = g)
    SELECT community, 'low_cohesion' AS kind FROM s WHERE cohesion < 0.5 AND files >= 5 UNION ALL SELECT community, 'oversized' FROM s WHERE share > 0.4"""))
def eng_subsystem_findings(spark, sf_dir):
    rows = graph.cohesion(_edges(spark, sf_dir), _members(spark, sf_dir))
    total = rows.agg(F.sum("files").alias("total"))
    low = rows.where("cohesion < 0.5 and files >= 5").select("community", F.lit("low_cohesion").alias("kind"))
    return low.unionByName(rows.crossJoin(F.broadcast(total)).where("files / total > 0.4").select("community", F.lit("oversized").alias("kind")))


@query()
def gr_louvain(spark, sf_dir):
    return communities.communities(_weights(spark, sf_dir))


@query()
def gr_louvain_levels(spark, sf_dir):
    """How many communities each level has, and their modularity."""
    _, levels = communities.community_levels(_weights(spark, sf_dir))
    return levels.withColumn("modularity", F.round("modularity", 9))


@query()
def gr_merge_cap(spark, sf_dir):
    w = graph.saved(_weights(spark, sf_dir))
    return graph.merge_small(w, communities.communities(w))


@query(oracle("edge4", """, k AS (SELECT DISTINCT src % 12 AS a, dst % 12 AS b FROM edge4 WHERE src % 12 <> dst % 12), r AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
    g AS (SELECT a AS grp FROM k UNION SELECT b FROM k), top AS (SELECT grp, least(grp, (SELECT min(x.b) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a = grp)) AS scc FROM g),
    dag AS (SELECT DISTINCT x.scc AS a, y.scc AS b FROM k JOIN top x ON k.a = x.grp JOIN top y ON k.b = y.grp WHERE x.scc <> y.scc), lv AS (SELECT DISTINCT scc AS a, 0 AS level FROM top UNION SELECT dag.b, lv.level + 1 FROM lv JOIN dag ON lv.a = dag.a WHERE lv.level < 7)
    SELECT grp, max(level)::INT AS level FROM top JOIN lv ON scc = a GROUP BY 1"""))
def gr_layers(spark, sf_dir):
    """Levels of a dozen groups of files, over all edges."""
    ends = _edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.group_levels(graph.group_edges(_edges(spark, sf_dir), ends.withColumn("grp", F.col("id") % 12)))


@query(oracle("file7", """, p AS (SELECT path_id, string_split(path, '/')[:-2] AS d FROM file7), x AS (SELECT path_id, unnest(range(1, len(d) + 1)) AS k, d FROM p)
    SELECT array_to_string(d[1:k], '/') AS folder, count(*) AS files, (k - 1)::INT AS depth FROM x GROUP BY 1, 3"""))
def dg_tree(spark, sf_dir):
    """Every folder with the files below it."""
    parts = F.split("path", "/")
    rows = bind(spark, sf_dir, "file7").select("path_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "folder"))
    return rows.groupBy("folder", "depth").agg(F.count("*").alias("files"))


FOLDERS = """, p AS (SELECT path_id, string_split(path, '/')[1] AS a, array_to_string(string_split(path, '/')[:-2][1:2], '/') AS b FROM file7),
    t AS (SELECT a, count(*) AS n, sum(count(*)) OVER () AS total FROM p GROUP BY a), g AS (SELECT path_id, CASE WHEN n > 0.5 * total OR (SELECT count(*) FROM t) < 3 THEN b ELSE p.a END AS grp FROM p JOIN t USING (a))"""


@query(oracle("file7", FOLDERS + "SELECT grp, count(*) AS files FROM g GROUP BY 1"))
def gr_folders(spark, sf_dir):
    """Files by folder; no folder dominates here, so the SQL needs one split at most."""
    return folders.folder_groups(bind(spark, sf_dir, "file7")).groupBy("grp").agg(F.count("*").alias("files"))


@query(
    oracle(
        "file7 last7",
        FOLDERS
        + """SELECT grp, count(*) AS files, sum(loc)::BIGINT AS loc, sum(churn_weighted) AS churn, sum(commit_count)::BIGINT AS commits, max(last_seen)::DATE::VARCHAR AS last_change
        FROM g JOIN file7 USING (path_id) LEFT JOIN last7 USING (path_id) GROUP BY 1""",
    )
)
def dg_payload(spark, sf_dir):
    """Size, activity and last change of each group of gr_folders."""
    files = bind(spark, sf_dir, "file7")
    own = files.join(folders.folder_groups(files), "path_id").join(bind(spark, sf_dir, "last7"), "path_id", "left")
    sums = [F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("churn_weighted").alias("churn"), F.sum("commit_count").alias("commits")]
    return own.groupBy("grp").agg(*sums, F.to_date(F.max("last_seen")).cast("string").alias("last_change"))


HIDDEN2 = coupling_sql("touch2") + """, near AS (SELECT CASE WHEN a = 7 THEN b ELSE a END AS path_id, shared_revs, degree FROM c_pairs WHERE a = 7 OR b = 7),
    b AS (SELECT 7::BIGINT AS id, 0 AS hops UNION SELECT e.src, hops + 1 FROM b JOIN edge4 e ON e.dst = b.id WHERE hops < 6), st AS (SELECT id, min(hops) AS hops FROM b GROUP BY 1)"""


@query(oracle("touch2 edge4", HIDDEN2 + """SELECT coalesce(st.id, near.path_id) AS path_id, hops, round(degree, 6) AS degree, st.id IS NULL AS surprising FROM (SELECT * FROM st WHERE id <> 7) st FULL JOIN near ON st.id = near.path_id"""))
def eng_blast(spark, sf_dir):
    """What a change of file 7 reaches: importers by hops, coupled files, and those that only history ties (surprising)."""
    pairs = coupling.coupling_of(bind(spark, sf_dir, "touch2"), 7)
    near = pairs.select(F.when(F.col("a") == 7, F.col("b")).otherwise(F.col("a")).alias("path_id"), F.round("degree", 6).alias("degree"))
    found = graph.bfs(_edges(spark, sf_dir), spark.createDataFrame([(7,)], "id long"), 6, reverse=True).where("id <> 7").withColumnRenamed("id", "path_id")
    return found.join(near, "path_id", "full").select("path_id", "hops", "degree", F.col("hops").isNull().alias("surprising"))


@query(oracle("touch2", """, s AS (SELECT commit_id, path_id FROM (SELECT *, count(*) OVER (PARTITION BY commit_id) AS n FROM touch2) WHERE n <= 30), me AS (SELECT commit_id FROM s WHERE path_id = 7)
    SELECT path_id, shared, round(shared / (SELECT count(*) FROM me)::DOUBLE, 6) AS share, examples FROM (SELECT path_id, count(*) AS shared, list(commit_id ORDER BY commit_id)[1:3] AS examples FROM s WHERE commit_id IN (SELECT commit_id FROM me) AND path_id <> 7 GROUP BY 1)
    ORDER BY shared DESC, path_id LIMIT 5"""))
def blast_evidence(spark, sf_dir):
    """The five files that most often change with file 7, with three commits each.

    Commit ids are numbered within a file, so no list grows beyond three.
    """
    from pyspark.sql import Window

    sets = coupling.changesets(bind(spark, sf_dir, "touch2"))
    mine = sets.where("item = 7").select("commit_id")
    n = mine.agg(F.count("*").alias("n"))
    seen = sets.join(mine, "commit_id", "left_semi").where("item <> 7").withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("commit_id")))
    got = seen.groupBy(F.col("item").alias("path_id")).agg(F.count("*").alias("shared"), F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("commit_id")))).alias("examples"))
    return got.crossJoin(F.broadcast(n)).select("path_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("share"), "examples").orderBy(F.desc("shared"), "path_id").limit(5)


@query(oracle("edge4 file7", "SELECT src, x.path AS from_path, dst, y.path AS to_path FROM edge4 JOIN file7 x ON src = x.path_id JOIN file7 y ON dst = y.path_id"))
def join_edges_alias(spark, sf_dir):
    names = bind(spark, sf_dir, "file7").select("path_id", "path")
    return _edges(spark, sf_dir).select("src", "dst").join(names.toDF("src", "from_path"), "src").join(names.toDF("dst", "to_path"), "dst")


@query(oracle("touch2 edge4", coupling_sql("touch2") + """, l AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM edge4)
    SELECT a, b FROM c_pairs EXCEPT SELECT a, b FROM l"""))
def set_difference(spark, sf_dir):
    """Pairs of history that structure does not have."""
    e = _edges(spark, sf_dir).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return coupling.coupling(bind(spark, sf_dir, "touch2")).select("a", "b").subtract(e)


__all__ = ["hidden"]
