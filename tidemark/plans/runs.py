"""Run catalog, sinks, reads, joins of insights with facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.bindings import bind, oracle
from tidemark.functions import numbers
from tidemark.operators import runs as ops, snapshots
from tidemark.plans.history import RISK, risks
from tidemark.registry import query

RUNS = """SELECT CAST(o_custkey AS STRING) AS repo_id, o_orderkey AS run_id, o_orderdate AS started_at,
    CASE o_orderstatus WHEN 'O' THEN 'superseded' WHEN 'F' THEN 'running' ELSE 'ready' END AS status FROM """
NOW = "TIMESTAMP '1998-06-01 00:00:00'"


def _runs(spark, sf_dir):
    return spark.sql(RUNS + "{orders}", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _now():
    return F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")


@query(f"SELECT repo_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, run_id DESC) AS r FROM ({RUNS} orders)) WHERE r = 1")
def win_latest_run(spark, sf_dir):
    return ops.latest_runs(_runs(spark, sf_dir))


@query(f"""WITH r AS ({RUNS} orders), l AS (SELECT repo_id, arg_max(run_id, (started_at, run_id)) AS run_id FROM r GROUP BY 1)
    SELECT repo_id, CASE WHEN repo_id::INT % 3 = 0 THEN 5 WHEN repo_id::INT % 3 = 1 THEN 6 ELSE run_id END::BIGINT AS run_id FROM l""")
def flt_run_scope(spark, sf_dir):
    """The run named, else the current one, else the newest."""
    runs = _runs(spark, sf_dir)
    repos = runs.select("repo_id").distinct()
    third = F.col("repo_id").cast("int") % 3
    asked = repos.withColumn("run_id", F.when(third == 0, F.lit(5).cast("long")))
    return ops.chosen_runs(asked, repos.withColumn("current_run_id", F.when(third == 1, F.lit(6).cast("long"))), runs)


@query(f"SELECT repo_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, run_id DESC) AS r FROM ({RUNS} orders) WHERE status = 'superseded') WHERE r > 3 AND started_at <= {NOW} - INTERVAL 7 DAY")
def win_keep_n(spark, sf_dir):
    return ops.evictable(_runs(spark, sf_dir), _now()).select("repo_id", "run_id")


@query(f"SELECT repo_id, run_id FROM ({RUNS} orders) WHERE status = 'running' AND started_at < {NOW} - INTERVAL 20 MINUTE")
def ops_reap(spark, sf_dir):
    return ops.stale(_runs(spark, sf_dir), _now()).select("repo_id", "run_id")


@query(f"SELECT repo_id FROM ({RUNS} orders) GROUP BY 1 HAVING max(started_at) < {NOW} - INTERVAL 30 DAY")
def ops_evict(spark, sf_dir):
    """Repositories whose facts have outlived 30 days."""
    return _runs(spark, sf_dir).groupBy("repo_id").agg(F.max("started_at").alias("last")).where(F.col("last") < _now() - F.expr("interval 30 days")).select("repo_id")


@query(f"SELECT repo_id, count(*) AS running, count(*) >= 3 AS at_limit FROM ({RUNS} orders) WHERE status = 'running' GROUP BY 1")
def ops_cap(spark, sf_dir):
    rows = _runs(spark, sf_dir).where("status = 'running'").groupBy("repo_id").agg(F.count("*").alias("running"))
    return rows.withColumn("at_limit", F.col("running") >= 3)


@query("""WITH o AS (SELECT user_id::VARCHAR AS repo_id, min(ts) AS lv FROM events GROUP BY 1), s AS (SELECT user_id::VARCHAR AS repo_id, max(ts) AS seen_at FROM events WHERE event_id % 2 = 0 GROUP BY 1)
    SELECT repo_id, strftime(CASE WHEN seen_at >= lv + INTERVAL 60 MINUTE THEN seen_at ELSE lv END, '%Y-%m-%d %H:%M:%S') AS last_viewed FROM o LEFT JOIN s USING (repo_id)""")
def ops_touch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("repo_id"), "ts", "event_id")
    old = events.groupBy("repo_id").agg(F.min("ts").alias("last_viewed"))
    got = ops.touched(old, events.where("event_id % 2 = 0").select("repo_id", F.col("ts").alias("at")))
    return got.select("repo_id", F.date_format("last_viewed", "yyyy-MM-dd HH:mm:ss").alias("last_viewed"))


@query(oracle("file7", ", k AS (SELECT path_id, path FROM file7 WHERE path_id % 2 = 0) SELECT path_id, path FROM k UNION ALL SELECT (SELECT max(path_id) FROM k) + row_number() OVER (ORDER BY path), path FROM file7 WHERE path NOT IN (SELECT path FROM k)"))
def snk_facts(spark, sf_dir):
    """Path ids: known ones stay, new ones are numbered on."""
    files = bind(spark, sf_dir, "file7").select("path_id", "path")
    return ops.interned(files.where("path_id % 2 = 0"), files)


@query("SELECT p_brand, p_type, p_size, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS p50 FROM part GROUP BY 1, 2, 3")
def snk_upsert(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_type", "p_size").distinct()
    return ops.upsert(part.withColumn("p50", F.lit(2.0)), part.where("p_size % 2 = 0").withColumn("p50", F.lit(1.0)), ["p_brand", "p_type", "p_size"])


@query("SELECT c_custkey, rank FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 END AS rank FROM customer) ORDER BY rank ASC NULLS LAST, c_custkey LIMIT 50")
def top_nulls_last(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 10).alias("rank"))
    return rows.orderBy(F.col("rank").asc_nulls_last(), "c_custkey").limit(50)


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def agg_counts(spark, sf_dir):
    out = None
    for name in ("orders", "lineitem", "customer", "events"):
        one = spark.read.parquet(f"{sf_dir}/{name}.parquet").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(oracle("touch2 file7", RISK + "SELECT path_id, path, loc, round(risk_score, 9) AS risk_score FROM file7 JOIN risk USING (path_id)"))
def join_metrics(spark, sf_dir):
    return bind(spark, sf_dir, "file7").join(risks(spark, sf_dir), "path_id").select("path_id", "path", "loc", "risk_score")


@query(oracle("touch2 file7", RISK + "SELECT path_id, loc, round(risk_score, 9) AS risk_score FROM file7 LEFT JOIN risk USING (path_id)"))
def join_city_outer(spark, sf_dir):
    return bind(spark, sf_dir, "file7").join(risks(spark, sf_dir), "path_id", "left").select("path_id", "loc", "risk_score")


@query(oracle("file7", "SELECT min(loc) AS loc_min, max(loc) AS loc_max, min(complexity) AS complexity_min, max(complexity) AS complexity_max, count(*) AS n FROM file7"))
def snk_columnar(spark, sf_dir):
    """Bounds of the columnar file grid."""
    return bind(spark, sf_dir, "file7").agg(F.min("loc").alias("loc_min"), F.max("loc").alias("loc_max"), F.min("complexity").alias("complexity_min"), F.max("complexity").alias("complexity_max"), F.count("*").alias("n"))


@query(oracle("file7 edge4", "SELECT path_id, path FROM file7 WHERE path_id IN (SELECT dst FROM edge4)"))
def join_semi_in(spark, sf_dir):
    return bind(spark, sf_dir, "file7").join(bind(spark, sf_dir, "edge4").select(F.col("dst").alias("path_id")), "path_id", "left_semi").select("path_id", "path")


@query(oracle("file7 edge4", "SELECT path_id, loc FROM file7 WHERE path_id NOT IN (SELECT dst FROM edge4) AND path_id % 10 <> 0 AND NOT is_deleted ORDER BY loc DESC, path_id LIMIT 25"))
def join_unreferenced(spark, sf_dir):
    """Live files that nothing imports and that start nothing (multiples of ten are entry points here)."""
    files = bind(spark, sf_dir, "file7").where("not is_deleted")
    entries = files.where("path_id % 10 = 0").select("path_id")
    used = bind(spark, sf_dir, "edge4").select(F.col("dst").alias("path_id"))
    return files.join(used, "path_id", "left_anti").join(entries, "path_id", "left_anti").select("path_id", "loc").orderBy(F.desc("loc"), "path_id").limit(25)


@query(oracle("touch2", "SELECT commit_id FROM touch2 WHERE path_id = 7"))
def join_array_contains(spark, sf_dir):
    """Commits that touch file 7, from the exploded touches."""
    return bind(spark, sf_dir, "touch2").where("path_id = 7").select("commit_id")


@query(oracle("touch3", ", m AS (SELECT commit_id, path_id, commit_id % 10000 AS y, commit_id // 10000 AS c FROM touch3) SELECT a.c AS author, a.y AS year, count(*) AS shared FROM m a JOIN m b ON a.c = b.c AND a.path_id = b.path_id AND b.y = a.y + 1 GROUP BY 1, 2"))
def set_intersection(spark, sf_dir):
    """Paths that an author touches in a year and in the next."""
    rows = bind(spark, sf_dir, "touch3").select(F.expr("commit_id div 10000").alias("author"), (F.col("commit_id") % 10000).alias("year"), "path_id")
    sets = rows.groupBy("author", "year").agg(F.collect_set("path_id").alias("paths"))
    both = sets.join(sets.select("author", (F.col("year") - 1).alias("year"), F.col("paths").alias("later")), ["author", "year"])
    return both.select("author", "year", F.size(F.array_intersect("paths", "later")).cast("long").alias("shared")).where("shared > 0")


@query("""WITH m AS (SELECT p_brand AS repo, median(p_retailprice) AS value FROM part GROUP BY 1) SELECT repo, round(value, 6) AS value, round(CASE WHEN value <= 500 THEN 0.0 WHEN value <= 1000 THEN (value - 500) / 500 * 0.5 WHEN value <= 2000 THEN 0.5 + (value - 1000) / 1000 * 0.4 ELSE 0.9 END::DOUBLE, 6) AS percentile FROM m""")
def agg_benchmark(spark, sf_dir):
    """A repository's median against the corpus' breakpoints."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("repo")).agg(F.median("p_retailprice").alias("value"))
    return rows.select("repo", F.round("value", 6).alias("value"), F.round(numbers.interpolate(F.col("value"), [(500.0, 0.0), (1000.0, 0.5), (2000.0, 0.9)]), 6).alias("percentile"))


@query("""WITH cells AS (SELECT p_type, p_size % 3 AS b, median(p_retailprice) AS p50, count(DISTINCT p_brand) AS n FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_brand) >= 5), wide AS (SELECT p_type, median(p_retailprice) AS p50 FROM part GROUP BY 1)
    SELECT p_partkey, round(coalesce(c.p50, w.p50), 6) AS p50, CASE WHEN c.p50 IS NULL THEN 'language' ELSE 'cell' END AS provenance FROM part p LEFT JOIN cells c ON c.p_type = p.p_type AND c.b = p.p_size % 3 LEFT JOIN wide w ON w.p_type = p.p_type""")
def base_seed(spark, sf_dir):
    """The breakpoint of a file's cell where five repositories are behind it, else that of its language."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("b", F.col("p_size") % 3)
    cells = part.groupBy("p_type", "b").agg(F.median("p_retailprice").alias("cell"), F.count_distinct("p_brand").alias("n")).where("n >= 5").drop("n")
    wide = part.groupBy("p_type").agg(F.median("p_retailprice").alias("wide"))
    rows = part.join(cells, ["p_type", "b"], "left").join(wide, "p_type", "left")
    return rows.select("p_partkey", F.round(F.coalesce("cell", "wide"), 6).alias("p50"), F.when(F.col("cell").isNull(), "language").otherwise("cell").alias("provenance"))


@query("SELECT o_orderstatus AS category, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS high, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS med, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low FROM orders GROUP BY 1")
def nar_facts(spark, sf_dir):
    """Findings by category, pivoted by severity."""
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "med").otherwise("low")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("category"), level.alias("level"))
    return rows.groupBy("category").agg(*[F.count_if(F.col("level") == k).alias(k) for k in ("high", "med", "low")])


@query(oracle("file7", "SELECT module, path, r AS place FROM (SELECT module, path, row_number() OVER (PARTITION BY module ORDER BY churn_weighted DESC, path)::INT AS r FROM file7) WHERE r <= 12"))
def dg_facts(spark, sf_dir):
    """The twelve most active paths of each group."""
    w = Window.partitionBy("module").orderBy(F.desc("churn_weighted"), "path")
    return bind(spark, sf_dir, "file7").withColumn("place", F.row_number().over(w)).where("place <= 12").select("module", "path", "place")


@query(oracle("touch2 file7", RISK + "SELECT path_id, rank FROM (SELECT path_id, round(risk_score, 9) AS s, row_number() OVER (ORDER BY round(risk_score, 9) DESC, path_id) - 1 AS rank FROM risk) WHERE s >= 0.4"))
def flt_findings(spark, sf_dir):
    """Filtering keeps the global rank."""
    from tidemark.operators import files

    return files.hotspot_rank(risks(spark, sf_dir)).where("risk_score >= 0.4").select("path_id", F.col("hotspot_rank").alias("rank"))


@query(oracle("head17 known17", """SELECT h.repo, h.head, CASE WHEN k.repo IS NULL THEN 'new' WHEN h.head = k.head THEN 'reuse' ELSE 'changed' END AS action FROM head17 h LEFT JOIN known17 k ON k.repo = h.repo"""))
def src_head_sha(spark, sf_dir):
    """Which repositories are scanned, and whose facts are used again."""
    return snapshots.compared(bind(spark, sf_dir, "head17"), bind(spark, sf_dir, "known17"))
