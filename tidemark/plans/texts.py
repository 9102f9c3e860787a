"""Commit logs, secrets, glossary, entry points, tour, passport."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.bindings import bind, oracle
from tidemark.functions import numbers, paths
from tidemark.operators import coupling, cycles, expertise, graph, onboarding
from tidemark.plans.graphs import WEIGHTS, pagerank_sql
from tidemark.plans.history import CYCLES, HIDDEN_ROWS, RISK, agg_churn_conc, risks, pairs
from tidemark.plans.links import coupling_sql, hidden
from tidemark.plans.paths import CVSS_SQL, IS_TEST, LANG, NAME, NON_SOURCE, STEM, VECTOR, interpolation_sql
from tidemark.plans.people import CONTRIB, DOA, TRUCK
from tidemark.registry import query
from tidemark.sources import code, gitlog, secrets

LOG = """SELECT concat(CAST(l_orderkey AS STRING), '\x1f', 'Name ', CAST(l_orderkey % 7 AS STRING), '\x1f', 'a@b.c', '\x1f', '2024-01-02T03:04:05+00:00', '\x1f', CASE WHEN l_orderkey % 5 = 0 THEN 'Revert it' ELSE 'fix it' END, '\x1f', CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'body' END, '\x1f',
    '\n', array_join(array_sort(collect_list(concat(CASE WHEN l_linenumber % 4 = 0 THEN '-' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END, '\t', CAST(l_linenumber AS STRING), '\t', CASE WHEN l_suppkey % 6 = 0 THEN 'dist\\\\' ELSE 'src\\\\' END, CAST(l_partkey AS STRING), '.py'))), '\n')) AS value
    FROM {lineitem} GROUP BY l_orderkey"""


def _commits(spark, sf_dir):
    """Records of a log, one an order, as the log's text source yields them."""
    return gitlog.parse_commits(spark.sql(LOG, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


@query("""SELECT l_orderkey::VARCHAR AS sha, 'src/' || l_partkey || '.py' AS path, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_quantity::INT END AS added, l_linenumber::INT AS deleted FROM lineitem WHERE l_suppkey % 6 <> 0""")
def src_numstat(spark, sf_dir):
    return gitlog.parse_touches(_commits(spark, sf_dir))


@query("""SELECT sha::VARCHAR AS sha, CASE WHEN sha % 5 = 0 THEN 'Revert it' ELSE 'fix it' END || CASE WHEN sha % 2 = 0 THEN '' ELSE chr(10) || chr(10) || 'body' END AS message, sha % 5 <> 0 AS is_fix, sha % 5 = 0 AS is_revert,
    files AS files_changed, ins AS insertions, del AS deletions FROM (SELECT l_orderkey AS sha, count(DISTINCT l_partkey) FILTER (WHERE l_suppkey % 6 <> 0) AS files,
    coalesce(sum(CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_quantity::INT END) FILTER (WHERE l_suppkey % 6 <> 0), 0)::BIGINT AS ins, coalesce(sum(l_linenumber) FILTER (WHERE l_suppkey % 6 <> 0), 0)::BIGINT AS del FROM lineitem GROUP BY 1)""")
def src_commit(spark, sf_dir):
    commits = _commits(spark, sf_dir)
    return gitlog.commit_totals(commits, gitlog.parse_touches(commits)).select("sha", "message", "is_fix", "is_revert", "files_changed", "insertions", "deletions")


def secret_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    tried = " UNION ALL ".join(
        f"SELECT doc_id, path, line_no, line, {quoted(rule)} AS rule, regexp_extract(line, {quoted(pattern)}, 1) AS value, {need or 'NULL'}::DOUBLE AS need FROM l WHERE ({' OR '.join(f'contains(lower(line), {quoted(k)})' for k in keys)}) AND regexp_matches(line, {quoted(pattern)})"
        for rule, pattern, need, keys in secrets.RULES
    )
    markers = " OR ".join(f"contains(lower(value), '{m}')" for m in secrets.SAMPLE_VALUES)
    return f""", l AS (SELECT doc_id, path, line, i AS line_no FROM (SELECT doc_id, path, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM doc6) WHERE length(line) <= 2000),
    t AS ({tried}), e AS (SELECT *, -list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: len(list_filter(string_split(value, ''), lambda x: x = c)) / length(value) * log2(len(list_filter(string_split(value, ''), lambda x: x = c)) / length(value)))) AS h FROM t),
    hits AS (SELECT doc_id, path, line_no, rule, value, sha256('salt:' || rule || ':' || trim(value)) AS fingerprint, CASE WHEN length(trim(value)) >= 12 THEN substr(trim(value), 1, 4) || repeat('*', 16) || right(trim(value), 2) END AS preview,
        CASE WHEN need IS NOT NULL THEN h END AS entropy FROM e WHERE (need IS NULL OR h >= need) AND NOT ({markers}) AND NOT (contains(line, 'data:image/') AND contains(line, ';base64,')))"""


def _hits(spark, sf_dir):
    return secrets.masked(secrets.scan_lines(secrets.lines_of(bind(spark, sf_dir, "doc6"))))


@query(oracle("doc6", secret_sql() + "SELECT doc_id, line_no, rule, fingerprint, preview, round(entropy, 6) AS entropy FROM hits"))
def sec_scan(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "rule", "fingerprint", "preview", F.round("entropy", 6).alias("entropy"))


@query(oracle("doc6", secret_sql() + "SELECT doc_id, rule, fingerprint, fingerprint IN (SELECT fingerprint FROM hits WHERE doc_id % 2 = 0) AS still_in_head FROM hits"))
def src_head_presence(spark, sf_dir):
    """Documents of even ids stand for the final tree."""
    hits = _hits(spark, sf_dir)
    return secrets.still_in_head(hits, hits.where("doc_id % 2 = 0")).select("doc_id", "rule", "fingerprint", "still_in_head")


@query(oracle("doc6", secret_sql() + ", known AS (SELECT DISTINCT path, ascii(path)::BIGINT AS path_id FROM doc6 WHERE path LIKE '%0') SELECT fingerprint, doc_id, path_id, count(*) OVER (PARTITION BY fingerprint) AS commits FROM (SELECT DISTINCT fingerprint, doc_id, path FROM hits) LEFT JOIN known USING (path)"))
def snk_secret(spark, sf_dir):
    from pyspark.sql import Window

    known = bind(spark, sf_dir, "doc6").where("path like '%0'").select("path", F.ascii("path").cast("long").alias("path_id")).distinct()
    rows = secrets.persisted(_hits(spark, sf_dir), known)
    return rows.select("fingerprint", "doc_id", "path_id", F.count("*").over(Window.partitionBy("fingerprint")).alias("commits"))


@query(oracle("doc6", secret_sql() + "SELECT doc_id, path, line_no, rule, fingerprint, preview, round(entropy, 6) AS entropy FROM hits"))
def src_secrets(spark, sf_dir):
    """Hits with their paths and line numbers; src_diff_secrets scans the added lines of patches."""
    return _hits(spark, sf_dir).select("doc_id", "path", F.col("line_no").cast("long").alias("line_no"), "rule", "fingerprint", "preview", F.round("entropy", 6).alias("entropy"))


@query("SELECT doc_id, regexp_replace(coalesce(text, ''), '(?i)((?:password|passwd|secret|token|api_?key)[\"'']?\\s*[:=]\\s*[\"'']?)[A-Za-z0-9+/_.=-]+', '\\1[redacted]', 'g') AS text FROM documents")
def sec_redact(spark, sf_dir):
    """Secrets replaced in log text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "(?i)((?:password|passwd|secret|token|api_?key)[\"']?\\s*[:=]\\s*[\"']?)[A-Za-z0-9+/_.=-]+", "$1[redacted]").alias("text"))


USES = f""", u AS (SELECT path_id, unnest(string_split(lower(regexp_replace(regexp_replace(regexp_replace({STEM}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')), ' ')) AS raw FROM file7 WHERE NOT is_deleted),
    uses AS (SELECT path_id, raw AS term FROM u WHERE length(raw) >= 3 AND raw NOT IN ({", ".join(f"'{w}'" for w in onboarding.STOPWORDS)}) AND NOT regexp_matches(raw, '^[a-z]{{1,3}}[0-9]+$')),
    terms AS (SELECT term, count(*) AS occurrences, count(DISTINCT module) AS spread, round(ln(1 + count(*)) * (1 + count(DISTINCT module) / (SELECT count(DISTINCT module) FROM file7)::DOUBLE), 9) AS score FROM uses JOIN file7 USING (path_id) GROUP BY 1 ORDER BY score DESC, term LIMIT 40)"""


def _uses(spark, sf_dir):
    files = bind(spark, sf_dir, "file7")
    return onboarding.term_uses(files.where("not is_deleted").select("path_id", paths.stem(F.col("path")).alias("name"))), files.select("path_id", F.col("module").alias("subsystem"))


@query(oracle("file7", USES + "SELECT term, occurrences, spread, round(score, 6) AS score FROM terms"))
def agg_glossary(spark, sf_dir):
    return onboarding.glossary(*_uses(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(oracle("file7", USES + """SELECT term, path_id, place FROM (SELECT term, path_id, row_number() OVER (PARTITION BY term ORDER BY path_id % 2 = 0 DESC, path_id % 3 = 0 DESC, path_id)::INT AS place FROM (SELECT DISTINCT term, path_id FROM uses JOIN terms USING (term))) WHERE place <= 5"""))
def gl_define(spark, sf_dir):
    """Every file's stem is its symbol here: a class for even ids, exported for multiples of three."""
    symbols = bind(spark, sf_dir, "file7").where("not is_deleted").select("path_id", paths.stem(F.col("path")).alias("name"), F.when(F.col("path_id") % 2 == 0, "class").otherwise("function").alias("kind"), (F.col("path_id") % 3 == 0).alias("exported"))
    return onboarding.defining_paths(onboarding.glossary(*_uses(spark, sf_dir)), symbols)


ROOTS = """, troot AS (SELECT path_id, path, string_split(path, '/') AS p FROM file7), tfirst AS (SELECT path_id, path, p, list_min(list_filter([CASE WHEN p[i] IN ('tests', 'test', '__tests__', 'spec') THEN i END for i in range(1, len(p))], lambda x: x IS NOT NULL)) AS k FROM troot)"""


@query(oracle("file7", ROOTS + "SELECT arg_min(path_id, path) AS path_id, array_to_string(p[1:k], '/') AS root FROM tfirst WHERE k IS NOT NULL GROUP BY 2").replace(" AS path_id, array_to_string(p[1:k], '/') AS root", " AS path_id, 'test_root' AS kind").replace("GROUP BY 2", "GROUP BY array_to_string(p[1:k], '/')"))
def ep_testroot(spark, sf_dir):
    return onboarding.test_roots(bind(spark, sf_dir, "file7")).select("path_id", "kind")


COMMANDS = "SELECT path_id AS command_no, concat('[\"python\", ', path, ' --port 80]') AS text FROM {file7} WHERE path_id % 10 = 0"


@query(oracle("file7", "SELECT path_id FROM file7 WHERE path_id % 10 = 0 AND NOT starts_with(path, '.')"))
def ep_resolve(spark, sf_dir):
    files = bind(spark, sf_dir, "file7")
    return onboarding.resolve_commands(spark.sql(COMMANDS, file7=files), files).select("path_id")


def _java_symbols(files):
    """Every fourth Java file has a main method here."""
    return files.where("path like '%.java' and path_id % 4 = 0").select("path_id", F.lit("method").alias("kind"), F.lit("main").alias("name"), F.lit(True).alias("exported"))


def _entries(spark, sf_dir):
    files = bind(spark, sf_dir, "file7")
    inferred = graph.inferred_entries(bind(spark, sf_dir, "edge4")).select(F.col("id").alias("path_id"), F.lit("inferred").alias("kind"), F.lit(0.5).alias("confidence"), F.lit(5).alias("rule_no"))
    named = onboarding.resolve_commands(spark.sql(COMMANDS, file7=files), files).unionByName(onboarding.test_roots(files)).unionByName(onboarding.conventional_entries(files))
    return named.unionByName(onboarding.java_mains(_java_symbols(files))).unionByName(inferred)


def _look(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


ENTRIES = ROOTS + f""", e AS (SELECT path_id, 'cli' AS kind, 0.95::DOUBLE AS confidence, 1 AS rule_no FROM file7 WHERE path_id % 10 = 0 UNION ALL SELECT arg_min(path_id, path), 'test_root', 0.9, 2 FROM tfirst WHERE k IS NOT NULL GROUP BY array_to_string(p[1:k], '/')
        UNION ALL SELECT path_id, kind, 0.75, 3 FROM (SELECT path_id, coalesce({_look(onboarding.EXACT_ENTRIES, 'path')}, {_look(onboarding.PY_ENTRIES, "list_last(string_split(path, '/'))")}) AS kind FROM file7) WHERE kind IS NOT NULL
        UNION ALL SELECT path_id, 'cli', 0.75, 4 FROM file7 WHERE path LIKE '%.java' AND path_id % 4 = 0
        UNION ALL SELECT src, 'inferred', 0.5, 5 FROM (SELECT src, count(*) AS n FROM edge4 WHERE src NOT IN (SELECT dst FROM edge4) GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 10)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY confidence DESC, rule_no, kind) AS r FROM e) WHERE r = 1)"""


@query(oracle("file7 edge4", ENTRIES + "SELECT path_id, kind, confidence, rule_no FROM best ORDER BY confidence DESC, rule_no, path_id LIMIT 20"))
def eng_entrypoints(spark, sf_dir):
    """By manifests, test folders, conventional names, Java main methods and files that nothing imports."""
    return onboarding.best_entries(_entries(spark, sf_dir))


@query(oracle("file7 edge4", ENTRIES + "SELECT path_id, kind, confidence FROM best"))
def win_best_entry(spark, sf_dir):
    """The best rule of every file that has one."""
    return onboarding.best_entries(_entries(spark, sf_dir), None).select("path_id", "kind", "confidence")


def _tour_candidates(spark, sf_dir):
    files, edges = bind(spark, sf_dir, "file7").where("not is_deleted"), bind(spark, sf_dir, "edge4")
    weights = graph.graph_weights(edges, coupling.coupling(bind(spark, sf_dir, "touch2")))
    # Rounded, so that ties are ties everywhere.
    ranks = graph.pagerank(weights, tolerance=1e-10).select("id", F.round("rank", 8).alias("rank"))
    degrees = graph.degrees(edges).select(F.col("id").alias("path_id"), "in_degree")
    groups = files.select("path_id", (F.col("path_id") % 6).alias("subsystem"))
    return onboarding.tour_candidates(files, onboarding.best_entries(_entries(spark, sf_dir)), ranks, groups, risks(spark, sf_dir), degrees)


NAMES = ", ".join(f"'{r}'" for r in onboarding.REASONS)
#: pagerank_sql ends in a SELECT of six digits; the CTEs before it are what is needed here.
TOUR = (RISK + WEIGHTS.removeprefix(coupling_sql("touch2")) + pagerank_sql(60).rsplit(" SELECT ", 1)[0] + ENTRIES + f""", pr AS (SELECT id AS path_id, round(rank, 8) AS rank FROM r60),
    live AS (SELECT path_id, path FROM file7 WHERE NOT is_deleted), fine AS (SELECT path_id, path FROM live WHERE NOT ({NON_SOURCE})), starts AS (SELECT path_id, kind, confidence FROM best ORDER BY confidence DESC, rule_no, path_id LIMIT 20),
    deg AS (SELECT id AS path_id, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 0 AS i FROM edge4 UNION ALL SELECT dst, 1 FROM edge4) GROUP BY 1), rk AS (SELECT path_id, round(risk_score, 9) AS risk_score FROM risk),
    central AS (SELECT path_id, path, rank FROM pr JOIN fine USING (path_id)),
    f1 AS (SELECT path_id, 1 AS no FROM starts JOIN fine USING (path_id) WHERE kind IN ('web_server', 'cli', 'ui_root') UNION ALL SELECT * FROM (SELECT path_id, 3 FROM central ORDER BY rank DESC, path LIMIT 3)
        UNION ALL SELECT path_id, 2 FROM (SELECT path_id, row_number() OVER (PARTITION BY path_id % 6 ORDER BY rank DESC, path) AS z FROM central) WHERE z = 1 UNION ALL SELECT * FROM (SELECT path_id, 5 FROM rk JOIN fine USING (path_id) ORDER BY risk_score DESC, path LIMIT 2)),
    f2 AS (SELECT * FROM f1 UNION ALL SELECT * FROM (SELECT path_id, 4 FROM deg JOIN fine USING (path_id) WHERE path_id NOT IN (SELECT path_id FROM f1) ORDER BY in_degree DESC, path LIMIT 2)
        UNION ALL SELECT * FROM (SELECT path_id, 0 FROM live WHERE starts_with(lower(list_last(string_split(path, '/'))), 'readme') ORDER BY len(string_split(path, '/')), path LIMIT 1)),
    cand AS (SELECT path_id, path, [{NAMES}][no + 1] AS reason, path_id % 6 AS subsystem, risk_score, CASE WHEN s.kind IN ('web_server', 'cli', 'ui_root') THEN s.confidence END AS confidence, coalesce(rank, 0.0) AS rank, coalesce(in_degree, 0) AS in_degree
        FROM (SELECT path_id, min(no) AS no FROM f2 GROUP BY 1) JOIN live USING (path_id) LEFT JOIN rk USING (path_id) LEFT JOIN starts s USING (path_id) LEFT JOIN pr USING (path_id) LEFT JOIN deg USING (path_id))""")


@query(oracle("touch2 file7 edge4", TOUR + "SELECT path_id, path, reason, subsystem, risk_score, confidence, rank, in_degree FROM cand"))
def tour_cand(spark, sf_dir):
    return _tour_candidates(spark, sf_dir)


@query()
def eng_tour(spark, sf_dir):
    """The last swap is a small step on the driver, so tests compare it with hand-made cases."""
    found = graph.saved(_tour_candidates(spark, sf_dir))
    hops = graph.bfs(bind(spark, sf_dir, "edge4"), found.where("reason = 'entry_point'").select(F.col("path_id").alias("id")), 1 << 20)
    return onboarding.tour(found, hops)


@query(oracle("file7", """SELECT (CASE WHEN bool_or(starts_with(n, 'readme')) THEN 0.5 ELSE 0 END + CASE WHEN bool_or(starts_with(n, 'readme') AND loc > 100) THEN 0.25 ELSE 0 END + CASE WHEN bool_or(starts_with(lower(path), 'docs/') OR starts_with(n, 'contributing')) THEN 0.25 ELSE 0 END)::DOUBLE AS doc_score
    FROM (SELECT path, loc, lower(list_last(string_split(path, '/'))) AS n FROM file7)"""))
def pp_doc(spark, sf_dir):
    return onboarding.doc_score(bind(spark, sf_dir, "file7"))


@query(oracle("file7", "SELECT path FROM file7 WHERE starts_with(lower(list_last(string_split(path, '/'))), 'readme') ORDER BY len(string_split(path, '/')), path LIMIT 1"))
def pp_manifest(spark, sf_dir):
    """The README that counts: the shallowest, then the first by path."""
    files = bind(spark, sf_dir, "file7").where(F.lower(paths.basename(F.col("path"))).startswith("readme"))
    return files.agg(F.min(F.struct(F.size(F.split("path", "/")), "path"))["path"].alias("path"))


def passport_sql(cycles: str = "count(*)") -> str:
    return PASSPORT.replace("CYCLES_COUNTED", cycles)


PASSPORT = DOA + CONTRIB + TRUCK + f""", newest AS (SELECT max(ts) AS last FROM commit1), conc AS (SELECT sum(churn_weighted) FILTER (WHERE r <= ceil(0.1 * n)) / sum(churn_weighted) AS churn_concentration FROM (SELECT churn_weighted, row_number() OVER (ORDER BY churn_weighted DESC, path_id) AS r, count(*) OVER () AS n FROM file7)),
    sizes AS (SELECT count(*) AS files, sum(loc)::BIGINT AS loc, count(DISTINCT module) AS subsystems, median(complexity) AS median_complexity, count(*) FILTER (WHERE {IS_TEST}) > 0 AS has_tests,
        (CASE WHEN bool_or(starts_with(n, 'readme')) THEN 0.5 ELSE 0 END + CASE WHEN bool_or(starts_with(n, 'readme') AND loc > 100) THEN 0.25 ELSE 0 END + CASE WHEN bool_or(starts_with(lower(path), 'docs/') OR starts_with(n, 'contributing')) THEN 0.25 ELSE 0 END)::DOUBLE AS doc_score FROM (SELECT *, lower({NAME}) AS n FROM file7)),
    cyc AS (SELECT CYCLES_COUNTED AS cycle_count FROM c), hid AS (SELECT count(*) AS hidden_count FROM hidden), tf AS (SELECT count(*) AS truck_factor FROM truck),
    pe AS (SELECT src % 5 AS x, dst % 5 AS y FROM edge4), coh AS (SELECT g, coalesce(i / (i + o), 0) AS cohesion FROM (SELECT DISTINCT src % 5 AS g FROM edge4) LEFT JOIN (SELECT z, sum(i) AS i, sum(o) AS o FROM (SELECT x AS z, 1 AS i, 0 AS o FROM pe WHERE x = y UNION ALL SELECT x, 0, 1 FROM pe WHERE x <> y UNION ALL SELECT y, 0, 1 FROM pe WHERE x <> y) GROUP BY 1) ON z = g),
    loose AS (SELECT min(g) AS loose_label, arg_min(cohesion, g) AS loose_cohesion FROM coh WHERE cohesion < 0.4), depth AS (SELECT max(hops)::BIGINT AS depth FROM (SELECT min(hops) AS hops FROM lay GROUP BY id)),
    one AS (SELECT *, date_diff('second', last, TIMESTAMP '1999-01-01') / 86400.0::DOUBLE AS idle_days FROM sizes, conc, cyc, hid, tf, loose, newest, depth)"""
LAY = ", lay AS (SELECT id, 0 AS hops FROM (SELECT path_id AS id FROM file7 WHERE path_id % 10 = 0 AND path_id IN (SELECT src FROM edge4)) UNION SELECT e.dst, hops + 1 FROM lay JOIN edge4 e ON e.src = lay.id WHERE hops < (SELECT count(DISTINCT src) FROM edge4))"
PASSPORT_SQL = "touch1 touch2 commit1 file7 edge4"
# How subsystem counts, complexity and depth stand among other repositories: (value, percentile).
CURVES = {"subsystems": [(1.0, 0.1), (10.0, 0.5), (100.0, 0.9)], "median_complexity": [(1.0, 0.1), (20.0, 0.5), (60.0, 0.9)], "depth": [(1.0, 0.1), (4.0, 0.5), (16.0, 0.9)]}


def _passport(spark, sf_dir):
    files, edges, touches, commits = (bind(spark, sf_dir, n) for n in ("file7", "edge4", "touch1", "commit1"))
    people = expertise.contributors(commits)
    top = expertise.experts(expertise.authorship(touches))
    sizes = files.agg(
        F.count("*").alias("files"), F.sum("loc").alias("loc"), F.count_distinct("module").alias("subsystems"), F.median("complexity").alias("median_complexity"), (F.count_if(paths.is_test(F.col("path"), paths.language(F.col("path")))) > 0).alias("has_tests")
    )
    coupled = pairs(spark, sf_dir)
    worst = risks(spark, sf_dir, coupled).orderBy(F.desc("risk_score"), "path_id").limit(10)
    orphan = worst.join(expertise.orphans(top, people), "path_id").join(files.select("path_id", "path"), "path_id").agg(F.max_by("path", F.struct("risk_score", -F.col("path_id"))).alias("orphaned_path"))
    members = edges.select(F.col("src").alias("id"), (F.col("src") % 5).alias("community")).distinct()
    loose = graph.cohesion(edges, members).where("cohesion < 0.4").agg(F.min("community").alias("loose_label"), F.min_by("cohesion", "community").alias("loose_cohesion"))
    starts = files.where("path_id % 10 = 0").select(F.col("path_id").alias("id")).join(edges.select(F.col("src").alias("id")), "id", "left_semi")
    parts = [
        sizes, onboarding.doc_score(files), expertise.truck_factor(top, people).agg(F.count("*").alias("truck_factor")), agg_churn_conc(spark, sf_dir).withColumnRenamed("share", "churn_concentration"), orphan, loose,
        cycles.count_cycles(edges), hidden(spark, sf_dir, coupled).agg(F.count("*").alias("hidden_count")), graph.bfs(edges, starts, None).agg(F.max("hops").cast("long").alias("depth")),
        commits.agg((F.timestamp_diff("SECOND", F.max("ts"), F.lit("1999-01-01").cast("timestamp_ntz")) / 86400.0).alias("idle_days")),
    ]
    one = parts[0]
    for part in parts[1:]:
        one = one.crossJoin(part)  # each is one row
    scaled = {k: numbers.interpolate(F.col(k).cast("double"), v) for k, v in CURVES.items()}
    hard = onboarding.difficulty(scaled["subsystems"], scaled["median_complexity"], F.col("doc_score"), F.col("truck_factor"), scaled["depth"])
    return onboarding.first_steps(one.withColumn("difficulty", hard))


SHOWN = ["files", "loc", "subsystems", "median_complexity", "has_tests", "doc_score", "truck_factor", "cycle_count", "hidden_count", "depth", "loose_label"]
_scaled = {k: interpolation_sql(f"{k}::DOUBLE", v) for k, v in CURVES.items()}


@query(oracle(PASSPORT_SQL, RISK + CYCLES + ", " + HIDDEN_ROWS + LAY + passport_sql() + f"""SELECT {", ".join(SHOWN)}, round(churn_concentration, 6) AS churn_concentration, round(idle_days, 6) AS idle_days, round(loose_cohesion, 6)::DOUBLE AS loose_cohesion,
    round(100 * (0.25e0 * {_scaled["subsystems"]} + 0.2e0 * {_scaled["median_complexity"]} + 0.2e0 * (1 - doc_score) + 0.2e0 * (1 - least(1.0, truck_factor / 4)) + 0.15e0 * {_scaled["depth"]}), 6) AS difficulty FROM one"""))
def eng_passport(spark, sf_dir):
    """One row: sizes, documentation, team, structure, activity and difficulty. A run of the first of January 1999."""
    return _passport(spark, sf_dir).select(*SHOWN, F.round("churn_concentration", 6).alias("churn_concentration"), F.round("idle_days", 6).alias("idle_days"), F.round("loose_cohesion", 6).alias("loose_cohesion"), F.round("difficulty", 6).alias("difficulty"))


@query(oracle(PASSPORT_SQL, RISK + CYCLES + ", " + HIDDEN_ROWS + LAY + passport_sql("least(count(*), 50)") + """SELECT code FROM (SELECT unnest(list_filter([CASE WHEN churn_concentration > 0.5 THEN 'HIGH_CHURN_CONCENTRATION' END, CASE WHEN truck_factor <= 2 THEN 'LOW_TRUCK_FACTOR' END,
    CASE WHEN (SELECT count(*) FROM (SELECT path_id FROM rk10 JOIN sole USING (path_id) JOIN people_rows USING (author) WHERE is_stale)) > 0 THEN 'ORPHANED_HOTSPOT' END, CASE WHEN hidden_count > 0 THEN 'HIDDEN_DEPENDENCIES' END, CASE WHEN cycle_count > 0 THEN 'CIRCULAR_DEPENDENCIES' END,
    CASE WHEN idle_days > 180 THEN 'DORMANT' END, CASE WHEN NOT has_tests THEN 'NO_TESTS' END, CASE WHEN loose_cohesion < 0.4 THEN 'LOW_COHESION_SUBSYSTEM' END], lambda x: x IS NOT NULL)[1:3]) AS code FROM one)""".replace("rk10", "(SELECT path_id FROM risk ORDER BY round(risk_score, 9) DESC, path_id LIMIT 10)")))
def pp_first_pr(spark, sf_dir):
    return _passport(spark, sf_dir).select(F.inline("first_steps")).select("code")


DEPS = "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem, p_brand AS package, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size % 5 AS STRING) END AS version, p_partkey % 3 = 0 AS is_direct FROM "


@query(f"SELECT ecosystem, package, version, bool_or(is_direct) AS is_direct FROM ({DEPS} part) WHERE version IS NOT NULL GROUP BY 1, 2, 3")
def agg_dedupe_deps(spark, sf_dir):
    return code.unique_dependencies(spark.sql(DEPS + "{part}", part=spark.read.parquet(f"{sf_dir}/part.parquet")))


@query(f"""WITH d AS (SELECT ecosystem, package, version, bool_or(is_direct) AS is_direct FROM ({DEPS} part) WHERE version IS NOT NULL GROUP BY 1, 2, 3)
    SELECT ecosystem, d.package, d.version, is_direct, 'ADV-' || a.p_partkey AS advisory FROM d JOIN (SELECT *, {VECTOR} AS vector FROM part WHERE p_partkey % 15 = 0) a ON a.p_brand = d.package AND (a.p_size % 5)::VARCHAR = d.version AND ecosystem = 'npm'""")
def src_osv(spark, sf_dir):
    """Advisories come from a table; there is no network."""
    return _advisories(spark, sf_dir).select("ecosystem", "package", "version", "is_direct", "advisory")


def _advisories(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    known = spark.sql(f"SELECT 'npm' AS ecosystem, p_brand AS package, CAST(p_size % 5 AS STRING) AS version, concat('ADV-', CAST(p_partkey AS STRING)) AS advisory, {VECTOR} AS vector FROM {{part}} WHERE p_partkey % 15 = 0", part=part)
    return code.advisories_for(code.unique_dependencies(spark.sql(DEPS + "{part}", part=part)), known)


@query(f"SELECT language, count(*) AS files FROM (SELECT {LANG} AS language FROM ({oracle('file7', 'SELECT path FROM file7')})) GROUP BY 1")
def agg_languages(spark, sf_dir):
    return bind(spark, sf_dir, "file7").groupBy(paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


@query(oracle("doc6", secret_sql() + f""", d AS (SELECT ecosystem, package, version, bool_or(is_direct) AS is_direct FROM ({DEPS} part) WHERE version IS NOT NULL GROUP BY 1, 2, 3),
    v AS (SELECT DISTINCT 'ADV-' || a.p_partkey AS advisory FROM d JOIN (SELECT * FROM part WHERE p_partkey % 15 = 0) a ON a.p_brand = d.package AND (a.p_size % 5)::VARCHAR = d.version AND ecosystem = 'npm'),
    b AS (SELECT advisory, CASE WHEN score >= 7.0 THEN 'high' WHEN score >= 4.0 THEN 'med' WHEN score IS NOT NULL THEN 'low' END AS band FROM v JOIN ({CVSS_SQL}) ON advisory = 'ADV-' || p_partkey)
    SELECT kind, severity, confidence, key FROM (SELECT 'secret' AS kind, 'high' AS severity, 0.9::DOUBLE AS confidence, fingerprint AS key FROM hits UNION ALL SELECT 'vulnerability', coalesce(band, 'low'), CASE WHEN band IS NULL THEN 0.5 ELSE 0.9 END, advisory FROM b)
    ORDER BY CASE severity WHEN 'high' THEN 2 WHEN 'med' THEN 1 ELSE 0 END DESC, confidence DESC, kind, key LIMIT 10"""))
def sec_findings(spark, sf_dir):
    """Secrets and the advisories of src_osv."""
    known = _advisories(spark, sf_dir).select("advisory", "band").distinct()
    return secrets.findings(_hits(spark, sf_dir), known)
