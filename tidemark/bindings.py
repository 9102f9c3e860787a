"""Commit-log facts bound to the star-schema tables.

Each binding is one SQL text that Spark and the oracle both read, so that operators and their
oracles start from the same facts and differ only in what they compute from them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def _pick(number: str, values: list[str]) -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


TOP = ["src", "tests", "lib", "app", "fixtures", "docs", "src/test"]
MIDDLE = ["ui", "service", "core", "db", "models", "views", ".config", "api", "billing"]
STEM = ["main", "index", "test_ledger", "orderParser", "LedgerTest", "conftest", "server", "invoice_test", "XMLReader", "cart.spec", "app", "README"]
EXT = [".py", ".ts", ".java", ".js", ".md", ".tsx"]

PATH = f"concat({_pick('p_partkey', TOP)}, '/', {_pick('p_size', MIDDLE)}, '/', {_pick('(p_partkey * 7)', STEM)}, CAST(p_partkey AS STRING), {_pick('(p_partkey + p_size)', EXT)})"

BINDINGS = {
    # One row for each commit (order) and path (supplier).
    "touch1": """SELECT l_orderkey AS commit_id, l_suppkey AS path_id, n_name AS author, o_orderdate AS ts, sum(l_quantity) AS churn
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        GROUP BY l_orderkey, l_suppkey, n_name, o_orderdate""",
    "commit1": """SELECT l_orderkey AS commit_id, n_name AS author, o_orderdate AS ts, o_orderpriority AS message, o_orderpriority = '1-URGENT' AS is_revert,
        count(DISTINCT l_suppkey) AS files_changed, sum(l_quantity) AS churn, sum(l_quantity) AS added, sum(CAST(l_linenumber AS BIGINT)) AS deleted
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        GROUP BY l_orderkey, n_name, o_orderdate, o_orderpriority""",
    "touch2": "SELECT DISTINCT o_custkey AS commit_id, l_suppkey AS path_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "touch3": """SELECT DISTINCT o_custkey * 10000 + year(o_orderdate) AS commit_id, p_brand AS path_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    # Import edges: the three suppliers that most often follow on the next line.
    "edge4": """SELECT src, dst, n FROM (SELECT src, dst, n, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM (
        SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS n FROM {lineitem} a JOIN {lineitem} b
        ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey GROUP BY a.l_suppkey, b.l_suppkey) x) y WHERE r <= 3""",
    "commit5": "SELECT event_id AS commit_id, user_id AS author, event_type AS path_id, ts, CASE WHEN event_id % 4 = 0 THEN 'WIP step' ELSE 'step' END AS message FROM {events}",
    "people": f"""SELECT c_custkey AS commit_id, o_orderdate AS ts,
        CASE WHEN c_custkey % 11 = 0 THEN 'dependabot[bot]' WHEN c_custkey % 7 = 0 THEN '  Root ' WHEN c_custkey % 2 = 0 THEN c_name ELSE concat('dev ', CAST(c_custkey % 40 AS STRING)) END AS name,
        CASE WHEN c_custkey % 5 = 0 THEN concat(CAST(c_custkey AS STRING), '+user', CAST(c_custkey % 60 AS STRING), '@users.noreply.github.com')
             WHEN c_custkey % 5 = 1 THEN concat({_pick('c_custkey', ['info', 'dev', 'team'])}, '@', CAST(c_custkey AS STRING), '.org')
             ELSE concat('User', CAST(c_custkey % 60 AS STRING), '@corp', CAST(c_custkey % 3 AS STRING), '.com') END AS email
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    # Files: a path for each part, with the history of its lines.
    "file7": f"""SELECT p_partkey AS path_id, {PATH} AS path, CAST(p_size AS BIGINT) * 13 AS loc, CAST(p_size AS DOUBLE) AS complexity, p_size % 17 = 0 AS is_deleted,
        count(DISTINCT l_orderkey) AS commit_count, coalesce(sum(l_quantity), 0) AS churn_weighted, p_brand AS module
        FROM {{part}} LEFT JOIN {{lineitem}} ON p_partkey = l_partkey GROUP BY p_partkey, p_size, p_brand""",
    # A source tree: a third each of Python, TypeScript and Java files that import one another.
    "tree8": """SELECT p_partkey AS k, p_size * 3 AS j, CASE p_partkey % 3 WHEN 0 THEN concat('pkg/m', CAST(p_partkey AS STRING), '.py') WHEN 1 THEN concat('web/c', CAST(p_partkey AS STRING), '.ts') ELSE concat('com/acme/C', CAST(p_partkey AS STRING), '.java') END AS path,
        CASE p_partkey % 3 WHEN 0 THEN concat('import os', chr(10), 'import pkg.m', CAST(p_size * 3 AS STRING), chr(10), 'from pkg import m', CAST(p_size * 3 + 3 AS STRING), ' as x', chr(10), chr(10),
            'class _K', CAST(p_partkey AS STRING), ':', chr(10), '    def run(self, a):', chr(10), '        if a and self:', chr(10), '            return 1', chr(10), '        return [b for b in a]', chr(10))
          WHEN 1 THEN concat('import {{ a }} from ', chr(39), './c', CAST(p_size * 3 + 1 AS STRING), chr(39), chr(10), 'export function f', CAST(p_partkey AS STRING), '(a) {{', chr(10), '  if (a) {{ return 2 }}', chr(10), '}}', chr(10), 'class K {{}}', chr(10))
          ELSE concat('package com.acme;', chr(10), 'import com.acme.C', CAST(p_size * 3 + 2 AS STRING), ';', chr(10), 'public class C', CAST(p_partkey AS STRING), ' {{', chr(10), '  public static void main(String[] args) {{', chr(10), '    for (;;) {{ }}', chr(10), '  }}', chr(10), '}}', chr(10)) END AS content FROM {part}""",
    # Manifests, one kind a row in turn.
    "tree9": """SELECT p_partkey AS k, concat('m', CAST(p_partkey AS STRING), '/', CASE p_partkey % 4 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'package.json' WHEN 2 THEN 'Procfile' ELSE 'README.md' END) AS path,
        CASE p_partkey % 4 WHEN 0 THEN concat('# pins', chr(10), 'Lib-', CAST(p_size AS STRING), '==1.', CAST(p_size AS STRING), chr(10), 'other', CAST(p_size % 5 AS STRING), '>=2', chr(10))
          WHEN 1 THEN concat('{{"name": "n', CAST(p_partkey AS STRING), '", "main": "index.js"}}') WHEN 2 THEN concat('web: python app', CAST(p_partkey AS STRING), '.py', chr(10)) ELSE concat('# Title', chr(10), 'text', chr(10)) END AS content FROM {part}""",
    # Scripts below two configurations, the inner of which extends a third; what they import lies in two folders.
    "tree12": """SELECT p_partkey AS k, p_size * 3 AS j, CASE p_partkey % 2 WHEN 0 THEN concat('apps/web/src/f', CAST(p_partkey AS STRING), '.ts') ELSE concat('apps/api/f', CAST(p_partkey AS STRING), '.ts') END AS path,
        concat('import {{ a }} from ', chr(39), '@lib/m', CAST(p_size * 3 AS STRING), chr(39), chr(10), 'import react from ', chr(39), 'react', chr(39), chr(10), 'const b = import(', chr(39), '@lib/m', CAST(p_size * 3 + 1 AS STRING), chr(39), ')', chr(10)) AS content FROM {part}
        UNION ALL SELECT p_partkey, 0, concat('shared/m', CAST(p_partkey AS STRING), '.ts'), 'export const a = 1' FROM {part}
        UNION ALL SELECT p_partkey, 0, concat('apps/web/lib/m', CAST(p_partkey AS STRING), '/index.ts'), 'export const a = 2' FROM {part} WHERE p_partkey % 6 < 3
        UNION ALL SELECT p_partkey, 0, 'tsconfig.json', '{{"compilerOptions": {{ // all
 "baseUrl": ".", "paths": {{"@lib/*": ["shared/*",]}}, }} }}' FROM {part} WHERE p_partkey = 1
        UNION ALL SELECT p_partkey, 0, 'apps/web/tsconfig.json', '{{"extends": "./conf/tsconfig.base", /* own */ "compilerOptions": {{"strict": true}}}}' FROM {part} WHERE p_partkey = 1
        UNION ALL SELECT p_partkey, 0, 'apps/web/conf/tsconfig.base.json', '{{"compilerOptions": {{"paths": {{"@lib/*": ["../lib/*", "../../../shared/*"]}}}}}}' FROM {part} WHERE p_partkey = 1""",
    # Three kinds of manifest; requirement files include a file that includes them again, and constraints.
    "tree13": """SELECT p_partkey AS k, p_size AS s, CASE p_partkey % 5 WHEN 0 THEN concat('p', CAST(p_partkey AS STRING), '/requirements.txt') WHEN 1 THEN concat('p', CAST(p_partkey - 1 AS STRING), '/deps/base.txt')
          WHEN 2 THEN concat('p', CAST(p_partkey - 2 AS STRING), '/deps/pins.txt') WHEN 3 THEN concat('p', CAST(p_partkey AS STRING), '/pyproject.toml') ELSE concat('p', CAST(p_partkey AS STRING), '/package-lock.json') END AS path,
        CASE p_partkey % 5 WHEN 0 THEN concat('Lib-', CAST(p_size AS STRING), '==1.', CAST(p_size AS STRING), '  # own', chr(10), '-r deps/base.txt', chr(10), '-c ./deps/pins.txt', chr(10))
          WHEN 1 THEN concat('shared', chr(10), 'other>=2', chr(10), '--requirement ../requirements.txt', chr(10)) WHEN 2 THEN concat('shared==3.', CAST(p_size AS STRING), chr(10), 'unused==1', chr(10))
          WHEN 3 THEN concat('[tool.poetry.dependencies]', chr(10), 'python = "^3.9"', chr(10), 'alpha = "1.', CAST(p_size AS STRING), '"', chr(10), 'beta = "^2.0"', chr(10))
          ELSE concat('{{"lockfileVersion": 3, "packages": {{"": {{"dependencies": {{"left": "1"}}}}, "node_modules/left": {{"version": "4.', CAST(p_size AS STRING), '"}}, "node_modules/left/node_modules/deep": {{"version": "5.0"}}}}}}') END AS content FROM {part}""",
    # A patch for each order: a file with two hunks, and one below an ignored folder.
    "patch10": """SELECT o_orderkey AS sha, concat('diff --git a/x b/x', chr(10), '--- a/src/f', CAST(o_custkey % 50 AS STRING), '.py', chr(10), '+++ b/src/f', CAST(o_custkey % 50 AS STRING), '.py', chr(10),
        '@@ -1,2 +', CAST(o_orderkey % 90 + 1 AS STRING), ',3 @@ def f():', chr(10), '+token = ', chr(39), 'ghp_', CAST(o_orderkey + 100000 AS STRING), 'abcdefghijklmnopqrstuvwxyzABCD', chr(39), chr(10), '-gone', chr(10), ' kept', chr(10), '+second', chr(10),
        '@@ -9 +', CAST(o_orderkey % 90 + 20 AS STRING), ' @@', chr(10), '+third', chr(10), 'diff --git a/y b/y', chr(10), '--- a/dist/y.js', chr(10), '+++ b/dist/y.js', chr(10), '@@ -0,0 +1 @@', chr(10), '+built', chr(10)) AS patch FROM {orders}""",
    # Sources with tests beside them, in a mirrored folder, elsewhere, or tied by an import alone.
    "file14": """SELECT p_partkey * 2 AS path_id, CASE p_partkey % 3 WHEN 0 THEN concat('pkg/m', CAST(p_partkey AS STRING), '.py') WHEN 1 THEN concat('web/c', CAST(p_partkey AS STRING), '.ts')
          ELSE concat('src/main/java/a/C', CAST(p_partkey AS STRING), '.java') END AS path, count(DISTINCT l_orderkey) AS commit_count FROM {part} LEFT JOIN {lineitem} ON p_partkey = l_partkey GROUP BY p_partkey
        UNION ALL SELECT p_partkey * 2 + 1, CASE WHEN p_partkey % 10 = 9 THEN concat('tests/other', CAST(p_partkey AS STRING), '.py') WHEN p_partkey % 12 = 0 THEN concat('pkg/test_m', CAST(p_partkey AS STRING), '.py')
          WHEN p_partkey % 3 = 0 THEN concat('checks/m', CAST(p_partkey AS STRING), '_test.py') WHEN p_partkey % 3 = 1 THEN concat('web/c', CAST(p_partkey AS STRING), '.spec.ts')
          ELSE concat('src/test/java/a/C', CAST(p_partkey AS STRING), 'Tests.java') END, 1 FROM {part} WHERE p_partkey % 2 = 0 OR p_partkey % 10 = 9""",
    "edge14": "SELECT p_partkey * 2 + 1 AS src, p_partkey * 2 - 4 AS dst FROM {part} WHERE p_partkey % 10 = 9 UNION ALL SELECT p_partkey * 2, 2 FROM {part} WHERE p_partkey % 7 = 0",
    "touch14": "SELECT l_orderkey AS commit_id, l_partkey * 2 AS path_id FROM {lineitem} UNION SELECT l_orderkey, l_partkey * 2 + 1 FROM {lineitem} WHERE l_suppkey % 5 = 0",
    # A file, a declared package and an entry point for each part, in eight groups.
    "stack15": f"""SELECT p_partkey AS k, concat('svc', CAST(p_partkey % 8 AS STRING)) AS grp,
        CASE WHEN p_partkey = 1 THEN '.gitlab-ci.yml' WHEN p_partkey = 2 THEN '.circleci/config.yml' WHEN p_partkey % 13 = 0 THEN concat('.github/workflows/w', CAST(p_partkey AS STRING), {_pick('p_partkey', ['.yml', '.YAML', '.md'])})
          ELSE concat('svc', CAST(p_partkey % 8 AS STRING), '/d', CAST(p_partkey AS STRING), '/', {_pick('p_partkey', ['Dockerfile', 'docker-compose.yml', 'Procfile', 'main.tf', 'app.py', 'render.yaml', 'Chart.yaml', 'Jenkinsfile', 'dev.dockerfile', 'Dockerfile.prod', 'serverless.yml'])}) END AS path,
        {_pick('p_partkey', ['PyPI', 'npm', 'PyPI', 'PyPI', 'npm', 'Maven'])} AS ecosystem, {_pick('p_partkey', ['psycopg2_Binary', 'left-pad', 'PyMySQL', 'pymongo', 'ioredis', 'org.x:mysql-connector-j'])} AS package,
        concat('svc', CAST(p_partkey % 8 AS STRING), '/d', CAST(p_partkey AS STRING), '/manifest') AS manifest,
        {_pick('p_partkey', ['web_server', 'test_root', 'cli', 'graph_inferred', 'build'])} AS kind, {_pick('p_partkey', ['Dockerfile CMD', 'Procfile web', 'package.json bin'])} AS evidence FROM {{part}}""",
    # A sentence about each part: true, rounded, false in a figure or a name, cut off, or too long.
    "text16": """SELECT p_partkey AS text_id, concat('file', CAST(p_partkey AS STRING)) AS subject, p_size AS size, p_size * 13 AS loc,
        CASE p_partkey % 7 WHEN 0 THEN concat('The file src/m', CAST(p_partkey AS STRING), '.py has ', CAST(p_size * 13 AS STRING), ' lines.')
          WHEN 1 THEN concat('Its risk_score says that ', CAST(p_size AS STRING), '% of the churn is recent!') WHEN 2 THEN 'An average of 7.77 commits, and 1,234 lines.'
          WHEN 3 THEN concat('See src/other', CAST(p_partkey AS STRING), '.py first.') WHEN 4 THEN concat('The file src/m', CAST(p_partkey AS STRING), '.py has')
          WHEN 5 THEN concat(repeat('many words ', 60), '.') ELSE concat('It has roughly ', CAST(p_size * 13 - p_size * 13 % 10 AS STRING), ' lines.') END AS text FROM {part}""",
    # Heads of forty repositories, and those of an earlier look at some of them.
    "head17": "SELECT concat('r', CAST(o_custkey % 40 AS STRING)) AS repo, concat('h', CAST(max(o_orderkey) AS STRING)) AS head FROM {orders} WHERE o_custkey % 40 < 35 GROUP BY o_custkey % 40",
    "known17": """SELECT concat('r', CAST(o_custkey % 40 AS STRING)) AS repo, concat('h', CAST(max(CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey END) AS STRING)) AS head
        FROM {orders} WHERE o_custkey % 40 >= 10 GROUP BY o_custkey % 40""",
    # When the lines of each part last changed.
    "last7": "SELECT l_partkey AS path_id, max(o_orderdate) AS last_seen FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_partkey",
    "doc6": "SELECT doc_id, source AS path, text FROM {documents}",
}


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = BINDINGS[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(names: str, body: str) -> str:
    """SQL for the oracle: the bindings named, then `body` (a SELECT, or ", x AS (...) SELECT ...")."""
    ctes = ", ".join(f"{n} AS ({BINDINGS[n].format(**{t: t for t in TABLES})})" for n in names.split())
    return f"WITH RECURSIVE {ctes} {body}"
