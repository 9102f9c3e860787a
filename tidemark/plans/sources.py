"""Source trees: files, imports, symbols, complexity, manifests, declared dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.bindings import bind, oracle
from tidemark.functions import paths
from tidemark.operators import baseline, graph, onboarding
from tidemark.registry import query
from tidemark.sources import code, diffs, secrets


def _tree(spark, sf_dir, name="tree8"):
    return bind(spark, sf_dir, name).select("path", "content")


#: Each file imports the file of the same kind that its size names, Python files two.
IMPORTS = """, i AS (SELECT path, k % 3 AS kind, j FROM tree8 UNION ALL SELECT path, 3, j FROM tree8 WHERE k % 3 = 0),
    t AS (SELECT path AS src, CASE kind WHEN 0 THEN 'pkg/m' || j || '.py' WHEN 3 THEN 'pkg/m' || (j + 3) || '.py' WHEN 1 THEN 'web/c' || (j + 1) || '.ts' ELSE 'com/acme/C' || (j + 2) || '.java' END AS dst,
        CASE kind WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' ELSE 'python' END AS language FROM i),
    imports AS (SELECT DISTINCT src, dst, language FROM t WHERE src <> dst AND dst IN (SELECT path FROM tree8))"""


def _imports(spark, sf_dir, language):
    return code.import_edges(_tree(spark, sf_dir)).where(F.col("language") == language).select("src", "dst")


@query(oracle("tree8", IMPORTS + "SELECT src, dst FROM imports WHERE language = 'python'"))
def src_imports_py(spark, sf_dir):
    return _imports(spark, sf_dir, "python")


@query(oracle("tree8", IMPORTS + "SELECT src, dst FROM imports WHERE language = 'javascript'"))
def src_imports_js(spark, sf_dir):
    return _imports(spark, sf_dir, "javascript")


@query(oracle("tree12", """, c AS (SELECT * FROM (VALUES ('', 1, 'shared/'), ('apps/web', 1, 'apps/web/lib/'), ('apps/web', 2, 'shared/')) AS c(folder, rank, target)),
    f AS (SELECT path AS src, j, 'static' AS kind FROM tree12 WHERE j > 0 UNION ALL SELECT path, j + 1, 'dynamic' FROM tree12 WHERE j > 0),
    deepest AS (SELECT f.*, arg_max(folder, length(folder)) OVER (PARTITION BY src, kind) AS near, folder, rank, target FROM f JOIN c ON folder = '' OR starts_with(src, folder || '/')),
    tried AS (SELECT src, kind, rank, path AS dst FROM deepest JOIN tree12 ON path IN (target || 'm' || deepest.j || '.ts', target || 'm' || deepest.j || '/index.ts') WHERE folder = near)
    SELECT src, arg_min(dst, rank) AS dst, kind FROM tried GROUP BY src, kind"""))
def src_imports_alias(spark, sf_dir):
    """Imports by name: each file by the aliases of the nearest configuration, one of which extends another."""
    return code.import_edges(_tree(spark, sf_dir, "tree12")).select("src", "dst", "kind")


@query(oracle("tree8", IMPORTS + "SELECT src, dst FROM imports WHERE language = 'java'"))
def src_imports_java(spark, sf_dir):
    return _imports(spark, sf_dir, "java")


@query(oracle("tree8", IMPORTS + "SELECT language, count(*) AS edges, count(DISTINCT src) AS importers FROM imports GROUP BY 1"))
def src_edge_union(spark, sf_dir):
    """The edges of all languages, counted by language."""
    return code.import_edges(_tree(spark, sf_dir)).groupBy("language").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("importers"))


@query(oracle("tree8", """SELECT path, name, kind, line::INT AS line, exported FROM (SELECT path, '_K' || k AS name, 'class' AS kind, 5 AS line, false AS exported FROM tree8 WHERE k % 3 = 0 UNION ALL SELECT path, 'run', 'function', 6, true FROM tree8 WHERE k % 3 = 0
    UNION ALL SELECT path, 'f' || k, 'function', 2, true FROM tree8 WHERE k % 3 = 1 UNION ALL SELECT path, 'K', 'class', 5, false FROM tree8 WHERE k % 3 = 1
    UNION ALL SELECT path, 'C' || k, 'class', 3, true FROM tree8 WHERE k % 3 = 2 UNION ALL SELECT path, 'main', 'method', 4, true FROM tree8 WHERE k % 3 = 2)"""))
def src_symbols(spark, sf_dir):
    return code.symbols(_tree(spark, sf_dir))


@query(oracle("tree8", "SELECT path, CASE k % 3 WHEN 0 THEN 8 WHEN 1 THEN 5 ELSE 7 END::INT AS loc, CASE k % 3 WHEN 0 THEN 4 ELSE 2 END::INT AS complexity FROM tree8"))
def src_complexity(spark, sf_dir):
    """Lines of code, and the branches of the most complex function."""
    return code.complexity(_tree(spark, sf_dir))


@query(oracle("tree8", "SELECT path, octet_length(encode(content))::BIGINT AS bytes, CASE k % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'java' END AS language FROM tree8"))
def src_tree(spark, sf_dir):
    """The files of a tree with their size and language."""
    return _tree(spark, sf_dir).select("path", F.octet_length("content").cast("long").alias("bytes"), paths.language(F.col("path")).alias("language"))


@query(oracle("tree9", """SELECT path, CASE k % 4 WHEN 0 THEN 'requirements' WHEN 1 THEN 'package_json' WHEN 2 THEN 'procfile' ELSE 'readme' END AS kind, CASE k % 4 WHEN 1 THEN 'n' || k WHEN 2 THEN 'python app' || k || '.py' WHEN 3 THEN 'Title' END AS detail FROM tree9"""))
def src_manifests(spark, sf_dir):
    """Each manifest with a field of its kind: a name, a command, a heading."""
    found = code.manifests(_tree(spark, sf_dir, "tree9"))
    field = lambda at: F.expr(f"try_variant_get(data, '{at}', 'string')")
    return found.select("path", "kind", F.when(F.col("kind") == "package_json", field("$.name")).when(F.col("kind") == "procfile", field("$.processes.web")).when(F.col("kind") == "readme", field("$.heading")).alias("detail"))


@query(oracle("tree13", """, r AS (SELECT a.path, a.s, b.path AS base, c.s AS pin FROM tree13 a LEFT JOIN tree13 b ON b.k = a.k + 1 LEFT JOIN tree13 c ON c.k = a.k + 2 WHERE a.k % 5 = 0)
    SELECT path, 'PyPI' AS ecosystem, 'lib-' || s AS package, '1.' || s AS version, true AS is_direct, path AS declared_in FROM r
    UNION ALL SELECT path, 'PyPI', 'shared', '3.' || pin, true, base FROM r WHERE base IS NOT NULL
    UNION ALL SELECT path, 'PyPI', 'other', NULL, true, base FROM r WHERE base IS NOT NULL
    UNION ALL SELECT path, 'PyPI', 'alpha', '1.' || s, true, path FROM tree13 WHERE k % 5 = 3
    UNION ALL SELECT path, 'PyPI', 'beta', NULL, true, path FROM tree13 WHERE k % 5 = 3
    UNION ALL SELECT path, 'npm', 'left', '4.' || s, true, path FROM tree13 WHERE k % 5 = 4
    UNION ALL SELECT path, 'npm', 'deep', '5.0', false, path FROM tree13 WHERE k % 5 = 4"""))
def src_declared_deps(spark, sf_dir):
    """Requirement files with what they include, Poetry tables, lock files."""
    return code.declared_dependencies(_tree(spark, sf_dir, "tree13"))


@query(oracle("tree8", IMPORTS + "SELECT src AS path, count(*) AS imports FROM imports WHERE src NOT IN (SELECT dst FROM imports) GROUP BY 1"))
def src_roots(spark, sf_dir):
    """Files that import others and are imported by none."""
    return graph.degrees(code.import_edges(_tree(spark, sf_dir))).where("in_degree = 0").select(F.col("id").alias("path"), F.col("out_degree").alias("imports"))


ADDED = """, added AS (SELECT o_orderkey AS sha, 'src/f' || (o_custkey % 50) || '.py' AS path, line_no, line FROM orders, LATERAL (SELECT o_orderkey % 90 + 1 AS line_no, 'token = ' || chr(39) || 'ghp_' || (o_orderkey + 100000) || 'abcdefghijklmnopqrstuvwxyzABCD' || chr(39) AS line
    UNION ALL SELECT o_orderkey % 90 + 3, 'second' UNION ALL SELECT o_orderkey % 90 + 20, 'third'))"""


@query(oracle("patch10", ADDED + "SELECT * FROM added"))
def src_added_lines(spark, sf_dir):
    """Added lines of patches with their numbers in the new file."""
    return diffs.added_lines(bind(spark, sf_dir, "patch10"), ["sha"])


@query(
    oracle(
        "patch10",
        ADDED
        + """, hit AS (SELECT sha, path, line_no, regexp_extract(line, '\\b(ghp_[0-9A-Za-z]{36})\\b', 1) AS value FROM added)
        SELECT sha, path, line_no, rule, sha256('salt:' || rule || ':' || value) AS fingerprint, substr(value, 1, 4) || repeat('*', 16) || right(value, 2) AS preview
        FROM hit, (VALUES ('github-pat'), ('generic-high-entropy-assignment')) AS r(rule) WHERE value <> ''""",
    )
)
def src_diff_secrets(spark, sf_dir):
    """The history scan: what any rule finds among added lines, by fingerprint and preview; no value leaves it."""
    found = secrets.scan_lines(diffs.added_lines(bind(spark, sf_dir, "patch10"), ["sha"]))
    return secrets.masked(found).select("sha", "path", "line_no", "rule", "fingerprint", "preview")


CELLS = "SELECT p_type AS language, CASE WHEN p_size <= 20 THEN 'small' ELSE 'medium' END AS bucket, count(DISTINCT p_brand) AS n_repos, count(*) AS n_files, min(p_retailprice) AS p0, median(p_retailprice) AS p50, max(p_retailprice) AS p100 FROM part GROUP BY 1, 2"


def _cells(part):
    bucket = F.when(F.col("p_size") <= 20, "small").otherwise("medium").alias("bucket")
    return part.groupBy(F.col("p_type").alias("language"), bucket).agg(F.count_distinct("p_brand").alias("n_repos"), F.count("*").alias("n_files"), F.min("p_retailprice").alias("p0"), F.median("p_retailprice").alias("p50"), F.max("p_retailprice").alias("p100"))


@query(f"""WITH c AS ({CELLS}), e AS (SELECT * FROM c WHERE n_repos >= 20), l AS (SELECT language, arg_max(p50, (n_repos, bucket)) AS p50 FROM e GROUP BY 1), a AS (SELECT arg_max(p50, (n_repos, language, bucket)) AS p50 FROM e)
    SELECT p_partkey, CASE WHEN e.p50 IS NOT NULL THEN 'cell' WHEN l.p50 IS NOT NULL THEN 'language' WHEN a.p50 IS NOT NULL THEN 'corpus' END AS provenance, round(coalesce(e.p50, l.p50, a.p50), 6) AS p50
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE p_type END AS language, CASE WHEN p_partkey % 5 = 0 THEN 'large' WHEN p_size <= 20 THEN 'small' ELSE 'medium' END AS bucket FROM part) w
    LEFT JOIN e ON e.language = w.language AND e.bucket = w.bucket LEFT JOIN l ON l.language = w.language, a""")
def base_widened(spark, sf_dir):
    """Cells of a corpus, widened to the language and to the whole where few repositories are behind one."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    bucket = F.when(F.col("p_partkey") % 5 == 0, "large").when(F.col("p_size") <= 20, "small").otherwise("medium")
    wanted = part.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "unknown").otherwise(F.col("p_type")).alias("language"), bucket.alias("bucket"))
    return baseline.widened(_cells(part), wanted, 20).select("p_partkey", "provenance", F.round("p50", 6).alias("p50"))


@query(f"""SELECT '{{"language":"' || language || '","bucket":"' || bucket || '","n_repos":' || n_repos || ',"n_files":' || n_files || '}}' AS json FROM ({CELLS})""")
def snk_json(spark, sf_dir):
    """Cells as JSON texts."""
    return baseline.as_json(_cells(spark.read.parquet(f"{sf_dir}/part.parquet")).select("language", "bucket", "n_repos", "n_files"))


@query(oracle("edge4", """, g AS (SELECT src % 12 AS a, dst % 12 AS b, count(*) AS n FROM edge4 WHERE src % 12 <> dst % 12 GROUP BY 1, 2)
    SELECT 0 AS line_no, 'flowchart LR' AS line UNION ALL SELECT row_number() OVER (ORDER BY n DESC, a, b)::INT, '  g_' || a || ' -->|' || n || '| g_' || b FROM g"""))
def snk_mermaid(spark, sf_dir):
    """Group edges as the lines of a flow chart, the heaviest first."""
    edges = bind(spark, sf_dir, "edge4")
    owner = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("grp", F.col("id") % 12)
    return baseline.mermaid(graph.group_edges(edges, owner))


@query(oracle("file7", """, m AS (SELECT CASE WHEN path_id % 4 = 0 THEN module ELSE string_split(path, '/')[1] END AS subsystem, string_split(path, '/') AS p FROM file7), t AS (SELECT subsystem, count(*) AS files FROM m GROUP BY 1),
    x AS (SELECT subsystem, k, array_to_string(p[1:k], '/') AS prefix, count(*) AS n FROM (SELECT subsystem, p, unnest(range(1, len(p))) AS k FROM m) GROUP BY 1, 2, 3),
    b AS (SELECT subsystem, arg_max(prefix, (k, n, prefix)) AS prefix FROM x JOIN t USING (subsystem) WHERE n >= 0.6 * files GROUP BY 1)
    SELECT subsystem, prefix FROM t LEFT JOIN b USING (subsystem)"""))
def gr_name_prefix(spark, sf_dir):
    """The deepest folder that holds three fifths of a group's files: groups by top folder, and by module, which have none."""
    group = F.when(F.col("path_id") % 4 == 0, F.col("module")).otherwise(F.split("path", "/")[0])
    files = bind(spark, sf_dir, "file7").select(group.alias("subsystem"), "path")
    return onboarding.common_folders(files).select("subsystem", F.array_join("prefix", "/").alias("prefix"))


@query()
def gr_naming(spark, sf_dir):
    """Labels of eight groups of files; choosing among labels in use is a step on one row a group, which tests check by hand."""
    files = bind(spark, sf_dir, "file7").select((F.col("path_id") % 8).alias("subsystem"), "path_id", "path")
    return onboarding.subsystem_names(files, files.select("path_id", F.lit("ledgerEntry").alias("name")))
