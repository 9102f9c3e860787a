"""Files, decay, risk, health, hygiene, percentiles, ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.bindings import bind, oracle
from tidemark.functions import numbers
from tidemark.operators import coupling, cycles, files, hygiene, tables
from tidemark.plans.links import coupling_sql, hidden
from tidemark.registry import query


@query(oracle("touch1 file7", """SELECT t.path_id, sum(churn) AS churn_total, count(DISTINCT commit_id) AS commit_count, min(ts)::DATE::VARCHAR AS first_seen, max(ts)::DATE::VARCHAR AS last_seen,
    NOT EXISTS (SELECT 1 FROM file7 f WHERE f.path_id = t.path_id AND NOT is_deleted) AS is_deleted FROM touch1 t GROUP BY t.path_id"""))
def src_files(spark, sf_dir):
    got = files.file_totals(bind(spark, sf_dir, "touch1"), bind(spark, sf_dir, "file7").where("not is_deleted"))
    return got.select("path_id", "churn_total", "commit_count", F.to_date("first_seen").cast("string").alias("first_seen"), F.to_date("last_seen").cast("string").alias("last_seen"), "is_deleted")


@query(oracle("touch1", """SELECT path_id, round(sum(churn * pow(0.5, age / 365)), 4) AS churn_weighted, coalesce(sum(churn) FILTER (WHERE age <= 365), 0) AS churn_recent
    FROM (SELECT *, date_diff('second', ts, (SELECT max(ts) FROM touch1)) / 86400.0::DOUBLE AS age FROM touch1) GROUP BY path_id"""))
def src_churn_decay(spark, sf_dir):
    return files.churn_decay(bind(spark, sf_dir, "touch1")).select("path_id", F.round("churn_weighted", 4).alias("churn_weighted"), "churn_recent")


RISK = coupling_sql("touch2") + """, mx AS (SELECT path_id, max(degree) AS mc FROM (SELECT a AS path_id, degree FROM c_pairs UNION ALL SELECT b, degree FROM c_pairs) GROUP BY 1),
    own AS (SELECT path_id, commit_count, churn_weighted * complexity AS cc, coalesce(mc, 0) AS mc FROM file7 LEFT JOIN mx USING (path_id) WHERE NOT is_deleted),
    r AS (SELECT min(cc) lc, max(cc) hc, min(mc) lm, max(mc) hm, min(commit_count) ln, max(commit_count) hn FROM own),
    risk AS (SELECT path_id, 0.60 * CASE WHEN hc = lc THEN 0.5 ELSE (cc - lc) / (hc - lc) END + 0.25 * CASE WHEN hm = lm THEN 0.5 ELSE (mc - lm) / (hm - lm) END
        + 0.15 * CASE WHEN hn = ln THEN 0.5 ELSE (commit_count - ln) / (hn - ln)::DOUBLE END AS risk_score, least(1.0, commit_count / 10.0)::DOUBLE AS confidence FROM own, r)"""


def pairs(spark, sf_dir):
    """The coupled pairs of a run, written once for all that follows from them."""
    return tables.saved(coupling.coupling(bind(spark, sf_dir, "touch2")))


def risks(spark, sf_dir, coupled=None):
    ends = coupling.max_coupling(coupling.coupling(bind(spark, sf_dir, "touch2")) if coupled is None else coupled)
    return files.risk(bind(spark, sf_dir, "file7"), ends).withColumn("risk_score", F.round("risk_score", 9))


@query(oracle("touch2 file7", RISK + "SELECT path_id, round(risk_score, 9) AS risk_score, confidence, CASE WHEN round(risk_score, 9) >= 0.7 THEN 'high' WHEN round(risk_score, 9) >= 0.4 THEN 'med' ELSE 'low' END AS severity FROM risk"))
def agg_risk(spark, sf_dir):
    return risks(spark, sf_dir).select("path_id", "risk_score", "confidence", "severity")


@query(oracle("touch2 file7", RISK + "SELECT path_id, row_number() OVER (ORDER BY round(risk_score, 9) DESC, path_id) - 1 AS hotspot_rank FROM risk"))
def win_hotspot_rank(spark, sf_dir):
    return files.hotspot_rank(risks(spark, sf_dir)).select("path_id", "hotspot_rank")


FND_RISK = """SELECT 'risk' AS category, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'med' ELSE 'low' END AS severity, confidence, path_id::VARCHAR AS subject, substr(sha256('risk:' || path_id), 1, 32) AS signature
    FROM (SELECT path_id, round(risk_score, 9) AS s, confidence FROM risk ORDER BY s DESC, path_id LIMIT 10)"""


@query(oracle("touch2 file7", RISK + FND_RISK))
def fnd_risk(spark, sf_dir):
    return files.risk_findings(risks(spark, sf_dir))


HIDDEN_ROWS = "hidden AS (SELECT * FROM c_pairs WHERE NOT EXISTS (SELECT 1 FROM edge4 WHERE (src = a AND dst = b) OR (src = b AND dst = a)))"
FND_HIDDEN = """SELECT 'hidden_dependency', CASE WHEN degree >= 0.65 THEN 'high' WHEN degree >= 0.45 THEN 'med' ELSE 'low' END, CASE WHEN low_confidence THEN 0.4 WHEN shared_revs >= 10 THEN 0.9 ELSE 0.65 END::DOUBLE,
    a::VARCHAR, substr(sha256('hidden_dependency:' || a || '|' || b), 1, 32) FROM hidden"""


@query(oracle("touch2 file7 edge4", RISK + f""", {HIDDEN_ROWS}, f AS ({FND_RISK} UNION ALL {FND_HIDDEN}),
    w AS (SELECT *, CASE severity WHEN 'high' THEN 30 WHEN 'med' THEN 20 ELSE 10 END + confidence AS weight FROM f)
    SELECT category, severity, round(confidence, 6) AS confidence, subject, signature, row_number() OVER (ORDER BY weight DESC, category, signature) - 1 AS rank FROM w"""))
def win_findings_rank(spark, sf_dir):
    coupled = pairs(spark, sf_dir)
    rows = files.risk_findings(risks(spark, sf_dir, coupled)).unionByName(coupling.hidden_findings(hidden(spark, sf_dir, coupled)))
    return files.rank_findings(rows).select("category", "severity", F.round("confidence", 6).alias("confidence"), "subject", "signature", "rank")


CYCLES = """, w AS (SELECT [src, dst] AS members FROM edge4 WHERE dst > src UNION ALL SELECT list_append(members, dst) FROM w JOIN edge4 ON src = members[-1] WHERE dst > members[1] AND NOT list_contains(members, dst) AND len(members) < 10),
    c AS (SELECT members, len(members)::INT AS size FROM w WHERE EXISTS (SELECT 1 FROM edge4 WHERE src = members[-1] AND dst = members[1]))"""


@query(oracle("touch2 file7 edge4", RISK + CYCLES + f""", {HIDDEN_ROWS}, h AS (SELECT count(*) FILTER (WHERE round(risk_score, 9) >= 0.6) / count(*)::DOUBLE AS ratio FROM risk),
    k AS (SELECT count(*) AS n FROM c), d AS (SELECT count(*) AS n FROM hidden)
    SELECT round(greatest(0.0, 100 - least(100.0, 40 * ratio) - least(30.0, 6.0 * k.n) - least(30.0, 3.0 * d.n)), 6)::DOUBLE AS score, round(ratio, 6) AS high_risk_ratio, k.n AS cycle_count, d.n AS hidden_count FROM h, k, d"""))
def agg_health(spark, sf_dir):
    coupled = pairs(spark, sf_dir)
    got = files.health(bind(spark, sf_dir, "file7"), risks(spark, sf_dir, coupled), cycles.count_cycles(bind(spark, sf_dir, "edge4")), hidden(spark, sf_dir, coupled))
    return got.select(F.round("score", 6).alias("score"), F.round("high_risk_ratio", 6).alias("high_risk_ratio"), "cycle_count", "hidden_count")


@query(oracle("touch1", """, c AS (SELECT DISTINCT commit_id, path_id, ts, commit_id % 3 = 0 AS is_fix FROM touch1) SELECT path_id, commit_id AS evidence_id, is_fix
    FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY is_fix DESC, ts DESC, commit_id DESC) AS r FROM c) WHERE r = 1"""))
def join_evidence(spark, sf_dir):
    touches = bind(spark, sf_dir, "touch1")
    return files.evidence(touches, touches.select("commit_id", "ts", (F.col("commit_id") % 3 == 0).alias("is_fix")).distinct())


def _percentile_sql(index: str) -> str:
    return f"SELECT o_orderpriority AS grp, value FROM (SELECT o_orderpriority, o_totalprice AS value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE i = {index}"


def _percentile(spark, sf_dir, rule):
    return files.percentile(spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderpriority", "grp"), "o_totalprice", 0.95, rule, ["grp"])


@query(_percentile_sql("floor(0.95 * (n - 1))"))
def agg_percentile_nr(spark, sf_dir):
    return _percentile(spark, sf_dir, "floor")


@query(_percentile_sql("round_even(0.95::DOUBLE * (n - 1), 0)"))
def agg_percentile_corpus(spark, sf_dir):
    return _percentile(spark, sf_dir, "corpus")


@query(_percentile_sql("greatest(1, round_even(0.95::DOUBLE * n, 0)) - 1"))
def agg_percentile_ops(spark, sf_dir):
    return _percentile(spark, sf_dir, "ops")


BIG = """, p AS (SELECT (SELECT files_changed FROM (SELECT files_changed, row_number() OVER (ORDER BY files_changed) - 1 AS i, count(*) OVER () AS n FROM commit1) WHERE i = floor(0.95 * (n - 1))) AS fc,
    (SELECT churn FROM (SELECT churn, row_number() OVER (ORDER BY churn) - 1 AS i, count(*) OVER () AS n FROM commit1) WHERE i = floor(0.95 * (n - 1))) AS cc),
    big AS (SELECT commit_id, files_changed, churn FROM commit1, p WHERE files_changed > fc AND churn > cc)"""


@query(oracle("commit1", BIG + "SELECT * FROM big"))
def eng_hygiene_oversized(spark, sf_dir):
    return hygiene.oversized(bind(spark, sf_dir, "commit1")).select("commit_id", "files_changed", "churn")


FIX = """, o AS (SELECT *, lag(author) OVER w AS pa, lag(ts) OVER w AS pt, lag(path_id) OVER w AS pp FROM commit5 WINDOW w AS (ORDER BY ts, commit_id)),
    b AS (SELECT *, sum(CASE WHEN pa = author AND date_diff('second', pt, ts) <= 7200 AND pp = path_id THEN 0 ELSE 1 END) OVER (ORDER BY ts, commit_id) AS island FROM o),
    fix AS (SELECT arg_min(commit_id, (ts, commit_id)) AS first_id, arg_max(commit_id, (ts, commit_id)) AS last_id, count(*) AS commits, any_value(author) AS author FROM b GROUP BY island
        HAVING count(*) >= 3 AND bool_or(regexp_matches(message, '(?i)\\b(wip|fixup|oops|typo|forgot|revert me|temp|asdf)\\b')))"""


def _steps(spark, sf_dir):
    """Twelve events make a person here, so that neighbours in time often are one author's."""
    return bind(spark, sf_dir, "commit5").withColumn("paths", F.array("path_id"))


@query(oracle("commit5", FIX + "SELECT * FROM fix"))
def win_fixup(spark, sf_dir):
    return hygiene.fixup_clusters(_steps(spark, sf_dir))


FIX2 = FIX.replace("commit5 WINDOW", "(SELECT commit_id, commit_id // 12 AS author, 'f' AS path_id, ts, message FROM commit5) WINDOW").replace("<= 7200", "<= 7200000")


@query(oracle("commit5", FIX2 + "SELECT * FROM fix"))
def win_fixup_long(spark, sf_dir):
    """The same with bursts of one author, a wide gap and one file, so that clusters cross days."""
    steps = bind(spark, sf_dir, "commit5").withColumn("author", F.expr("commit_id div 12")).withColumn("paths", F.array(F.lit("f")))
    return hygiene.fixup_clusters(steps, minutes=120_000)


RISKY = """, c80 AS (SELECT churn FROM (SELECT churn, row_number() OVER (ORDER BY churn) - 1 AS i, count(*) OVER () AS n FROM commit1) WHERE i = floor(0.8 * (n - 1))),
    per AS (SELECT commit_id, count(DISTINCT path_id % 12) AS subs, bool_or(path_id % 10 = 0) AS tested FROM touch1 GROUP BY 1),
    risky AS (SELECT commit_id, (subs >= 3)::INT + (churn >= (SELECT churn FROM c80))::INT + (NOT tested)::INT + (length(trim(message)) < 15)::INT AS score FROM commit1 JOIN per USING (commit_id))"""


def _risky(spark, sf_dir):
    touches = bind(spark, sf_dir, "touch1")
    groups = touches.select("path_id", (F.col("path_id") % 12).alias("subsystem")).distinct()
    return hygiene.risky(bind(spark, sf_dir, "commit1"), touches, groups, touches.where("path_id % 10 = 0").select("path_id").distinct())


@query(oracle("commit1 touch1", RISKY + "SELECT * FROM risky WHERE score >= 3"))
def eng_hygiene_risky(spark, sf_dir):
    return _risky(spark, sf_dir)


@query(oracle("commit1 touch1", BIG + """, raw AS (SELECT path_id, sum(CASE WHEN t.commit_id IN (SELECT commit_id FROM big) THEN 1 ELSE 0 END + CASE WHEN t.commit_id % 50 = 0 THEN 1 ELSE 0 END + CASE WHEN is_revert THEN 2 ELSE 0 END)::BIGINT AS raw
    FROM (SELECT DISTINCT path_id, commit_id FROM touch1) t JOIN commit1 USING (commit_id) GROUP BY 1)
    SELECT path_id, raw, round(CASE WHEN hi = lo THEN 0.5 ELSE (raw - lo) / (hi - lo)::DOUBLE END, 6) AS instability FROM raw, (SELECT min(raw) AS lo, max(raw) AS hi FROM raw)"""))
def eng_instability(spark, sf_dir):
    commits = bind(spark, sf_dir, "commit1")
    got = hygiene.instability(bind(spark, sf_dir, "touch1"), hygiene.oversized(commits), commits.where("commit_id % 50 = 0"), commits)
    return got.select("path_id", "raw", F.round("instability", 6).alias("instability"))


EVENTS = FIX2 + """, ev AS (SELECT 'fixup' AS kind, first_id AS commit_id, commits::VARCHAR AS detail, 0.6::DOUBLE AS confidence FROM fix UNION ALL SELECT 'oversized', commit_id, files_changed::VARCHAR, 0.7::DOUBLE FROM big UNION ALL
    SELECT 'risky', commit_id, score::VARCHAR, score / 4.0::DOUBLE FROM risky WHERE score >= 3)"""


def _events(spark, sf_dir):
    """Fix-ups are those of win_fixup_long."""
    return hygiene.events(hygiene.oversized(bind(spark, sf_dir, "commit1")), win_fixup_long(spark, sf_dir), _risky(spark, sf_dir))


@query(oracle("commit1 touch1 commit5", BIG + RISKY + EVENTS + "SELECT kind, commit_id, detail FROM ev"))
def hyg_events(spark, sf_dir):
    return _events(spark, sf_dir).select("kind", "commit_id", F.map_values("detail")[0].alias("detail"))


@query(oracle("commit1 touch1 commit5", BIG + RISKY + EVENTS + """SELECT 'hygiene' AS category, CASE kind WHEN 'fixup' THEN 'low' ELSE 'med' END AS severity, confidence, commit_id::VARCHAR AS subject, substr(sha256('hygiene:' || kind || ':' || commit_id), 1, 32) AS signature
    FROM ev ORDER BY kind = 'fixup', confidence DESC, signature LIMIT 8"""))
def fnd_hygiene(spark, sf_dir):
    return hygiene.findings(_events(spark, sf_dir))


@query("SELECT o_custkey, count(*) AS n, round(avg(gap), 6) AS mean_gap, max(gap) AS longest FROM (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders) GROUP BY 1")
def win_gap(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gaps = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.date_diff(F.to_date("o_orderdate"), F.to_date(F.lag("o_orderdate").over(w))).cast("long").alias("gap"))
    return gaps.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.max("gap").alias("longest"))


@query(oracle("touch1", """, w AS (SELECT isoyear(ts) AS y, weekofyear(ts) AS k, count(DISTINCT commit_id) AS n FROM touch1 GROUP BY 1, 2), d AS (SELECT DISTINCT ts::DATE AS d FROM touch1), m AS (SELECT max(ts) AS last FROM touch1)
    SELECT (SELECT count(DISTINCT commit_id) FROM touch1, m WHERE ts >= last - INTERVAL 30 DAY) AS d30, (SELECT count(DISTINCT commit_id) FROM touch1, m WHERE ts >= last - INTERVAL 90 DAY) AS d90,
    (SELECT count(DISTINCT commit_id) FROM touch1, m WHERE ts >= last - INTERVAL 365 DAY) AS d365, (SELECT median(n) FROM w) AS week_median, (SELECT max(g) FROM (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS g FROM d)) AS longest_gap"""))
def agg_cadence(spark, sf_dir):
    """Commits of the last 30, 90 and 365 days, the median of active ISO weeks, the longest gap between active days."""
    own = bind(spark, sf_dir, "touch1").select("commit_id", "ts").distinct()
    last = own.agg(F.max("ts").alias("last"))
    recent = own.crossJoin(F.broadcast(last)).agg(*[F.count_if(F.expr(f"ts >= last - interval {n} days")).alias(f"d{n}") for n in (30, 90, 365)])
    weeks = own.groupBy(F.extract(F.lit("YEAROFWEEK"), "ts"), F.extract(F.lit("WEEK"), "ts")).agg(F.count("*").alias("n")).agg(F.median("n").alias("week_median"))
    # One row a day.
    days = own.select(F.to_date("ts").alias("d")).distinct()
    gaps = days.select(F.date_diff("d", F.lag("d").over(Window.orderBy("d"))).cast("long").alias("g")).agg(F.max("g").alias("longest_gap"))
    return recent.crossJoin(weeks).crossJoin(gaps)


@query(oracle("file7", "SELECT round(sum(churn_weighted) FILTER (WHERE r <= ceil(0.1 * n)) / sum(churn_weighted), 6) AS share FROM (SELECT churn_weighted, row_number() OVER (ORDER BY churn_weighted DESC, path_id) AS r, count(*) OVER () AS n FROM file7)"))
def agg_churn_conc(spark, sf_dir):
    """The share of all churn in the tenth of the files with most of it."""
    own = bind(spark, sf_dir, "file7").select("path_id", "churn_weighted")
    ranked = tables.global_rank(own, [F.desc("churn_weighted"), F.asc("path_id")])
    total = own.agg(F.count("*").alias("n"))
    return ranked.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.when(F.col("rank") < F.ceil(F.lit(0.1) * F.col("n")), F.col("churn_weighted"))) / F.sum("churn_weighted"), 6).alias("share"))


@query("SELECT n_regionkey, arg_max(c_mktsegment, (n, c_mktsegment)) AS mode FROM (SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def agg_mode(spark, sf_dir):
    """The dominant value of each group; ties to the greatest name."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet")), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = rows.groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return counts.groupBy("n_regionkey").agg(F.max(F.struct("n", "c_mktsegment"))["c_mktsegment"].alias("mode"))


@query("""SELECT event_type AS stage, count(*) AS n, round(count(*) FILTER (WHERE event_id % 10 = 0) / count(*)::DOUBLE, 6) AS failure_rate,
    max(value) FILTER (WHERE i = greatest(1, round_even(0.5 * m, 0))) AS p50, max(value) FILTER (WHERE i = greatest(1, round_even(0.95::DOUBLE * m, 0))) AS p95
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1""")
def agg_stage_stats(spark, sf_dir):
    """For each stage its runs, failure rate and the median and 95th percentile of its seconds."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "stage")
    out = rows.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("event_id") % 10 == 0) / F.count("*"), 6).alias("failure_rate"))
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        out = out.join(files.percentile(rows, "value", q, "ops", ["stage"]).withColumnRenamed("value", name), "stage")
    return out


@query("""SELECT p_type AS language, CASE WHEN p_size <= 20 THEN 'small' ELSE 'medium' END AS bucket, count(DISTINCT p_brand) AS n_repos, count(*) AS n_files, round(median(p_retailprice), 6) AS p50,
    max(p_retailprice) FILTER (WHERE i = round_even(0.9::DOUBLE * (m - 1), 0)) AS p90 FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY p_type, p_size <= 20) AS m FROM part WINDOW w AS (PARTITION BY p_type, p_size <= 20 ORDER BY p_retailprice)) GROUP BY 1, 2""")
def agg_corpus_cells(spark, sf_dir):
    """Breakpoints of a metric by language and size bucket, with the repositories and files behind them."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("language"), numbers.size_bucket(F.col("p_size")).alias("bucket"), "p_brand", "p_retailprice")
    cells = rows.groupBy("language", "bucket").agg(F.count_distinct("p_brand").alias("n_repos"), F.count("*").alias("n_files"), F.round(F.median("p_retailprice"), 6).alias("p50"))
    return cells.join(files.percentile(rows, "p_retailprice", 0.9, "corpus", ["language", "bucket"]).withColumnRenamed("value", "p90"), ["language", "bucket"])
