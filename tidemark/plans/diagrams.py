"""Diagrams of what is visible, infrastructure and callers, tests of sources, grounding of sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.bindings import bind, oracle
from tidemark.operators import diagram, narrative, testmap
from tidemark.plans.links import HIDDEN, hidden
from tidemark.registry import query

#: Folders that are open: a folder below one that is closed stays out of sight.
OPEN = ["src", "lib", "lib/core", "docs/ui"]
OPEN_SQL = ", open AS (SELECT unnest([" + ", ".join(f"'{f}'" for f in OPEN) + "]) AS folder)"
OWNERS = (
    OPEN_SQL
    + """, pre AS (SELECT path_id, path, k, array_to_string(string_split(path, '/')[1:k], '/') AS folder FROM (SELECT path_id, path, unnest(range(1, len(string_split(path, '/')))) AS k FROM file7)),
    near AS (SELECT path_id, arg_min(folder, k) AS folder FROM pre WHERE folder NOT IN (SELECT folder FROM open) GROUP BY 1),
    own AS (SELECT path_id, coalesce(near.folder, path) AS owner FROM file7 LEFT JOIN near USING (path_id))"""
)


def _owners(spark, sf_dir):
    return diagram.owners(bind(spark, sf_dir, "file7"), spark.createDataFrame([(f,) for f in OPEN], "folder string"))


@query(oracle("file7", OWNERS + "SELECT * FROM own"))
def gr_visible_owner(spark, sf_dir):
    """The folder or file that stands for each file while some folders are open."""
    return _owners(spark, sf_dir)


PROJECTION = (
    HIDDEN
    + OWNERS
    + """, up AS (SELECT src, dst, x.owner AS source, y.owner AS target FROM edge4 JOIN own x ON src = x.path_id JOIN own y ON dst = y.path_id WHERE x.owner <> y.owner),
    fr AS (SELECT src AS a, dst AS b FROM edge4 UNION SELECT fr.a, e.dst FROM fr JOIN edge4 e ON fr.b = e.src),
    og AS (SELECT DISTINCT source AS a, target AS b FROM up), gr AS (SELECT a, b FROM og UNION SELECT gr.a, og.b FROM gr JOIN og ON gr.b = og.a),
    imp AS (SELECT source, target, count(*) AS edges, bool_or(f.a IS NOT NULL) OR bool_or(g.a IS NOT NULL) AS in_cycle, list([src, dst] ORDER BY src, dst)[1:20] AS pairs
        FROM up LEFT JOIN fr f ON f.a = dst AND f.b = src LEFT JOIN gr g ON g.a = target AND g.b = source GROUP BY source, target),
    hid AS (SELECT least(x.owner, y.owner) AS source, greatest(x.owner, y.owner) AS target, count(*) AS edges, max(degree) AS max_degree, sum(shared_revs)::BIGINT AS shared_revs, list([a, b] ORDER BY a, b)[1:20] AS pairs
        FROM hidden JOIN own x ON a = x.path_id JOIN own y ON b = y.path_id WHERE x.owner <> y.owner GROUP BY 1, 2),
    flagged AS (SELECT *, (SELECT count(*) FROM imp) > 60 AND edges < 2 AND NOT in_cycle AS weak FROM imp)"""
)


@query(
    oracle(
        "touch2 edge4 file7",
        PROJECTION
        + """SELECT 'import' AS kind, source, target, edges, in_cycle, NULL::DOUBLE AS max_degree, NULL::BIGINT AS shared_revs, pairs, (SELECT count(*) FROM flagged WHERE weak) AS weak_hidden FROM flagged WHERE NOT weak
        UNION ALL SELECT 'hidden', source, target, edges, false, round(max_degree, 6), shared_revs, pairs, (SELECT count(*) FROM flagged WHERE weak) FROM hid""",
    )
)
def gr_projection(spark, sf_dir):
    """Imports and hidden pairs between visible nodes; weak edges are left out and counted."""
    found = diagram.projected(bind(spark, sf_dir, "edge4"), hidden(spark, sf_dir), _owners(spark, sf_dir))
    weak = found.agg(F.count_if("weak").alias("weak_hidden"))
    pairs = F.transform("file_pairs", lambda p: F.array(p["src"], p["dst"])).alias("pairs")
    shown = found.where("not weak").crossJoin(F.broadcast(weak))  # one row
    return shown.select("kind", "source", "target", "edges", "in_cycle", F.round("max_degree", 6).alias("max_degree"), "shared_revs", pairs, "weak_hidden")


TESTS = r""", f AS (SELECT *, list_last(string_split(path, '/')) AS name FROM file14), t AS (SELECT path_id, path, name FROM f WHERE regexp_matches(name, '^test_|_test\.py$|\.spec\.|Tests\.java$') OR starts_with(path, 'tests/')),
    s AS (SELECT path_id, path, name, commit_count FROM f WHERE path_id NOT IN (SELECT path_id FROM t)),
    asked AS (SELECT path_id, CASE WHEN starts_with(name, 'test_') THEN replace(path, 'test_', '') WHEN name LIKE '%\_test.py' ESCAPE '\' THEN replace(path, '_test', '') WHEN contains(name, '.spec.') THEN replace(path, '.spec.', '.')
        WHEN name LIKE '%Tests.java' THEN replace(replace(path, 'Tests.java', '.java'), 'src/test', 'src/main') END AS want FROM t),
    direct AS (SELECT asked.path_id AS test_id, s.path_id AS source_id, 1 AS no FROM asked JOIN s ON want = path),
    names AS (SELECT name, min(path_id) AS source_id FROM s GROUP BY 1 HAVING count(*) = 1),
    stem AS (SELECT path_id AS test_id, source_id, 2 AS no FROM asked JOIN names ON list_last(string_split(want, '/')) = name WHERE path_id NOT IN (SELECT test_id FROM direct)),
    imp AS (SELECT src AS test_id, dst AS source_id, 3 AS no FROM edge14 WHERE src IN (SELECT path_id FROM t) AND dst IN (SELECT path_id FROM s)),
    tied AS (SELECT test_id, source_id, min(no) AS no FROM (SELECT * FROM direct UNION ALL SELECT * FROM stem UNION ALL SELECT * FROM imp) GROUP BY 1, 2)"""


@query(oracle("file14 edge14", TESTS + "SELECT test_id, source_id, ['mirror', 'stem', 'import'][no] AS rule FROM tied"))
def join_test_map(spark, sf_dir):
    """Tests with the sources that they stand for, by name, by a stem that is alone, or by an import."""
    return testmap.test_map(bind(spark, sf_dir, "file14"), bind(spark, sf_dir, "edge14"))


GAPS = """, n AS (SELECT source_id AS path_id, count(*) AS tests FROM tied GROUP BY 1),
    along AS (SELECT DISTINCT commit_id, source_id AS path_id FROM touch14 JOIN tied ON path_id = test_id),
    r AS (SELECT c.path_id, count(b.path_id) / count(*) AS ratio FROM touch14 c JOIN n ON n.path_id = c.path_id LEFT JOIN along b ON b.commit_id = c.commit_id AND b.path_id = c.path_id GROUP BY 1),
    g AS (SELECT s.path_id, CASE WHEN tests IS NULL THEN NULL ELSE coalesce(ratio, 0)::DOUBLE END AS ratio, coalesce(tests, 0) AS tests, commit_count FROM s LEFT JOIN n ON n.path_id = s.path_id LEFT JOIN r ON r.path_id = s.path_id)
    SELECT path_id, CASE WHEN ratio IS NULL THEN 'no_test' WHEN ratio < 0.2 AND commit_count >= 5 THEN 'stale_test' ELSE 'tracked' END AS classification, round(ratio, 6) AS ratio, tests FROM g"""


@query(oracle("file14 edge14 touch14", TESTS + GAPS))
def eng_test_gaps(spark, sf_dir):
    """Sources without a test, with one that does not change along, and the others."""
    files = bind(spark, sf_dir, "file14")
    found = testmap.test_gaps(files, testmap.test_map(files, bind(spark, sf_dir, "edge14")), bind(spark, sf_dir, "touch14"))
    return found.withColumn("ratio", F.round("ratio", 6))


INFRA = r""", h AS (SELECT path, lower(list_last(string_split(path, '/'))) AS name FROM stack15),
    hit AS (SELECT 'infra:docker' AS id, 'container' AS category, 'Docker' AS label, path, 'Dockerfile present' AS evidence FROM h WHERE name = 'dockerfile' OR starts_with(name, 'dockerfile.') OR ends_with(name, '.dockerfile')
        UNION ALL SELECT 'infra:compose', 'container', 'Docker Compose', path, 'Compose file present' FROM h WHERE name = 'docker-compose.yml' UNION ALL SELECT 'infra:procfile', 'deploy', 'Procfile', path, 'Procfile present' FROM h WHERE name = 'procfile'
        UNION ALL SELECT 'infra:terraform', 'deploy', 'Terraform', path, 'Terraform files present' FROM h WHERE ends_with(name, '.tf') UNION ALL SELECT 'infra:render', 'deploy', 'Render', path, 'render.yaml present' FROM h WHERE name = 'render.yaml'
        UNION ALL SELECT 'infra:helm', 'deploy', 'Helm chart', path, 'Helm Chart.yaml present' FROM h WHERE name = 'chart.yaml' UNION ALL SELECT 'infra:jenkins', 'ci', 'Jenkins', path, 'Jenkinsfile present' FROM h WHERE name = 'jenkinsfile'
        UNION ALL SELECT 'infra:serverless', 'deploy', 'Serverless Framework', path, 'serverless.yml present' FROM h WHERE name = 'serverless.yml' UNION ALL SELECT 'infra:gitlab-ci', 'ci', 'GitLab CI', path, '.gitlab-ci.yml present' FROM h WHERE path = '.gitlab-ci.yml'
        UNION ALL SELECT 'infra:circleci', 'ci', 'CircleCI', path, '.circleci/config.yml present' FROM h WHERE path = '.circleci/config.yml'
        UNION ALL SELECT 'infra:github-actions', 'ci', 'GitHub Actions', path, count(*) OVER () || ' workflow file(s) in .github/workflows' FROM h WHERE regexp_matches(path, '^\.github/workflows/.*\.(yml|YAML)$')
        UNION ALL SELECT * FROM (SELECT CASE package WHEN 'psycopg2_Binary' THEN 'infra:postgresql' WHEN 'pymongo' THEN 'infra:mongodb' WHEN 'ioredis' THEN 'infra:redis' WHEN 'left-pad' THEN NULL ELSE 'infra:mysql' END AS id, 'datastore',
            CASE package WHEN 'psycopg2_Binary' THEN 'PostgreSQL' WHEN 'pymongo' THEN 'MongoDB' WHEN 'ioredis' THEN 'Redis' ELSE 'MySQL' END, manifest, 'declared dependency ' || package || ' in ' || manifest FROM stack15) WHERE id IS NOT NULL),
    runs AS (SELECT CASE WHEN starts_with(evidence, 'Dockerfile') THEN 'infra:docker' ELSE 'infra:procfile' END AS id, list(DISTINCT grp ORDER BY grp) AS g FROM stack15 WHERE NOT starts_with(evidence, 'package') GROUP BY 1),
    node AS (SELECT id, category, label, list(DISTINCT evidence ORDER BY evidence)[1:5] AS evidence, list(DISTINCT path ORDER BY path)[1:10] AS paths FROM hit GROUP BY 1, 2, 3)
    SELECT node.id, category, label, evidence, paths, coalesce(g, []::VARCHAR[]) AS runs_groups FROM node LEFT JOIN runs ON runs.id = node.id"""


@query(oracle("stack15", INFRA))
def eng_infra(spark, sf_dir):
    """What files and packages say about containers, deployment, builds and datastores."""
    own = bind(spark, sf_dir, "stack15")
    declared = own.select("ecosystem", "package", F.col("manifest").alias("path"))
    return diagram.infrastructure(own.select("path"), declared, own.select("path", "evidence"), own.select("path", "grp"))


@query(
    oracle(
        "stack15",
        "SELECT 'actor' AS id, 'Users & callers' AS label, list(DISTINCT grp ORDER BY grp) AS group_ids, list(DISTINCT kind ORDER BY kind) AS entry_kinds FROM stack15 WHERE kind IN ('web_server', 'ui_root', 'cli')",
    )
)
def dg_actor(spark, sf_dir):
    """Whom the groups with entry points serve."""
    own = bind(spark, sf_dir, "stack15")
    return diagram.actor(own.select("path", "kind"), own.select("path", "grp"))


def _facts(own):
    """Three facts a subject: its lines, a share, and its path."""
    fact = lambda name, value, words: F.struct(F.lit(name).alias("name"), value.alias("value"), words.alias("words"))
    none = F.lit(None)
    path = F.concat(F.lit("src/m"), F.col("text_id").cast("string"), F.lit(".py"))
    facts = F.array(fact("loc", F.col("loc").cast("double"), none.cast("string")), fact("risk_score", F.col("size") / 100.0, none.cast("string")), fact("path", none.cast("double"), path), fact("file", none.cast("double"), F.element_at(F.split(path, "/"), -1)))
    return own.select("subject", F.explode(facts).alias("x")).select("subject", "x.*")


GROUND = """, q AS (SELECT *, loc - loc % 10 AS figure, text_id % 7 AS c FROM text16), v AS (SELECT text_id, loc AS value FROM q UNION ALL SELECT text_id, size / 100 FROM q UNION ALL SELECT text_id, size FROM q),
    near AS (SELECT DISTINCT q.text_id FROM q JOIN v ON v.text_id = q.text_id, (VALUES (5), (10), (25), (50), (100), (1000), (10000)) AS s(s)
        WHERE figure = value OR (s <= greatest(value, 1) * 10 AND figure % s = 0 AND (abs(figure - value) * 2 < s OR (abs(figure - value) * 2 = s AND figure // s % 2 = 0)))),
    j AS (SELECT q.text_id, CASE WHEN c = 5 THEN 'too_long' WHEN c = 4 THEN 'looks_truncated' WHEN c = 2 OR (c = 6 AND near.text_id IS NULL) THEN 'ungrounded_number' WHEN c = 3 THEN 'ungrounded_reference' END AS reason FROM q LEFT JOIN near ON near.text_id = q.text_id)
    SELECT text_id, reason IS NULL AS ok, reason FROM j"""


@query(oracle("text16", GROUND))
def nar_validate(spark, sf_dir):
    """Sentences about parts, with planted figures and names that no fact holds."""
    own = bind(spark, sf_dir, "text16")
    return narrative.validated(own, _facts(own), spark.createDataFrame([("is_test",)], "name string"))
