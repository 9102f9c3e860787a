"""Aliases of the nearest configuration, and requirement files that include others: hand-made trees."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.paths import ancestors, normal
from tidemark.sources import aliases, code, requirements


def tree_of(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_paths_are_made_normal(spark):
    cases = {"a/./b//c": "a/b/c", "a/../b": "b", "../a": "../a", "a/../../b": "../b", "": "", "./": "", "a/b/..": "a", "../../x/../y": "../../y"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", normal(F.col("p")).alias("n"), ancestors(F.col("p")).alias("up")).collect()
    assert {r.p: r.n for r in rows} == cases
    assert next(r.up for r in rows if r.p == "a/./b//c") == ["", "a", "a/.", "a/./b", "a/./b/c"] and next(r.up for r in rows if r.p == "") == [""]


def test_json_with_comments():
    text = '{ // one\n "a": "x // no, /* no */ ,]", /* two\n, */ "b": [1, 2,], }'
    assert aliases.plain_json(text).replace(" ", "").replace("\n", "") == '{"a":"x//no,/*no*/,]","b":[1,2]}'


SCRIPT = "import x from '@app/one'\nexport { y } from '@exact'\nconst z = require('lodash')\nimport w from '~/deep/two.js'\n"
FILES = {
    "tsconfig.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@app/*": ["app/*"], "@exact": ["exact/index.ts"]}}}',
    "jsconfig.json": '{"compilerOptions": {"paths": {"@app/*": ["wrong/*"]}}}',
    "src/app/one.ts": "",
    "src/exact/index.ts": "",
    "src/main.ts": SCRIPT,
    # Without patterns of its own, and a chain that bites its tail.
    "apps/tsconfig.json": '{"extends": "./tsconfig.mid.json", "compilerOptions": {"baseUrl": "./lib"}}',
    "apps/tsconfig.mid.json": '{"extends": "../shared/tsconfig.top"}',
    "shared/tsconfig.top.json": '{"extends": "../apps/tsconfig.json", "compilerOptions": {"baseUrl": "ignored", "paths": {"~/*": ["*"], "@app/*/end": ["../never/*"], "@app/*": ["missing/*", "second/*"]}}}',
    "apps/lib/second/one.tsx": "",
    "apps/lib/deep/two.ts": "",
    "apps/web/page.ts": SCRIPT,
    # Damaged: its folder has none of its own, so the one above counts.
    "apps/bad/tsconfig.json": '{"compilerOptions": {',
    "apps/bad/page.ts": SCRIPT,
    # Patterns without a base start where they are written.
    "lone/conf/tsconfig.base.json": '{"compilerOptions": {"paths": {"@app/*": ["../here/*"]}}}',
    "lone/tsconfig.json": '{"extends": "./conf/tsconfig.base.json"}',
    "lone/here/one/index.js": "",
    "lone/page.js": SCRIPT + "import('./page2')\nimport '/src/main'\n",
    "lone/page2.js": "import './page'\nimport('./page')\n",
}


def test_each_file_takes_the_nearest_configuration(spark):
    got = {(r.src, r.dst, r.kind) for r in code.import_edges(tree_of(spark, FILES)).collect()}
    assert got == {
        ("src/main.ts", "src/app/one.ts", "static"), ("src/main.ts", "src/exact/index.ts", "static"),
        ("apps/web/page.ts", "apps/lib/second/one.tsx", "static"), ("apps/web/page.ts", "apps/lib/deep/two.ts", "static"),
        ("apps/bad/page.ts", "apps/lib/second/one.tsx", "static"), ("apps/bad/page.ts", "apps/lib/deep/two.ts", "static"),
        ("lone/page.js", "lone/here/one/index.js", "static"), ("lone/page.js", "lone/page2.js", "dynamic"), ("lone/page.js", "src/main.ts", "static"),
        ("lone/page2.js", "lone/page.js", "static"),
    }


def test_chains_are_resolved_with_their_base(spark):
    raw = code.parsed(tree_of(spark, FILES).where("path like '%config%'"), aliases.config_of, ["extends", "base", "paths"], "extends string, base string, paths string")
    got = {r.folder: r.base for r in aliases.configurations(raw).collect()}
    assert got == {"": "src", "apps": "apps/lib", "lone": "lone/conf"}


def test_trees_without_configurations(spark):
    got = code.import_edges(tree_of(spark, {"a.ts": "import './b'\nimport '@x/y'", "b.ts": ""})).collect()
    assert [(r.src, r.dst) for r in got] == [("a.ts", "b.ts")]
    assert code.import_edges(tree_of(spark, {"README": "import './b'"})).count() == 0


PIP = {
    # A chain and a diamond: two ways to common.txt.
    "requirements.txt": "-r req/a.txt\n-r req/b.txt\nFlask[async]==2.0 # pinned\n-e .\ngit+https://x/y\n--index-url https://z\n",
    "req/a.txt": "-r common.txt\nalpha>=1\n",
    "req/b.txt": "-r ./common.txt\nbeta==1.1\n-c limits.txt\n",
    "req/common.txt": "common\n-r missing.txt\n",
    "req/limits.txt": "alpha==1.5\nnobody==9\ncommon==7\n-r more.txt\n",
    "req/more.txt": "beta==2\n",
    # A cycle of two roots.
    "svc/requirements-dev.txt": "-r requirements.txt\npytest==8\n",
    "svc/requirements.txt": "--requirement requirements-dev.txt\nrequests\n",
    "notes.txt": "not a manifest\n",
}


def test_requirements_follow_their_references(spark):
    rows = code.declared_dependencies(tree_of(spark, PIP)).collect()
    got = {(r.path, r.package, r.version, r.declared_in) for r in rows}
    assert len(rows) == len(got) and got == {
        ("requirements.txt", "flask", "2.0", "requirements.txt"), ("requirements.txt", "alpha", "1.5", "req/a.txt"), ("requirements.txt", "beta", "1.1", "req/b.txt"),
        ("requirements.txt", "common", "7", "req/common.txt"),
        ("svc/requirements.txt", "requests", None, "svc/requirements.txt"), ("svc/requirements.txt", "pytest", "8", "svc/requirements-dev.txt"),
        ("svc/requirements-dev.txt", "requests", None, "svc/requirements.txt"), ("svc/requirements-dev.txt", "pytest", "8", "svc/requirements-dev.txt"),
    }


def test_a_long_chain_and_a_file_that_is_both(spark):
    lines = [(f"r{i}.txt", 1, "requirement", f"r{i + 1}.txt", None) for i in range(12)] + [("r12.txt", 1, "package", "end", None), ("r0.txt", 2, "constraint", "r12.txt", None)]
    df = spark.createDataFrame(lines, "path string, line int, kind string, name string, version string")
    roots = spark.createDataFrame([("r0.txt",)], "path string")
    assert {r.file: r.constrains for r in requirements.closure(df, roots).collect()} == {f"r{i}.txt": False for i in range(13)}
    assert [(r.package, r.declared_in) for r in requirements.required(df, roots).collect()] == [("end", "r12.txt")]


@pytest.mark.parametrize("spec,pin", [("1.2.3", "1.2.3"), ("==1.2", "1.2"), ("^1.2", None), ("~1.2", None), (">=1,<2", None), ("*", None), ({"version": "3.0", "extras": ["x"]}, "3.0"), ({"git": "https://x"}, None)])
def test_poetry_pins(spec, pin):
    assert code.poetry_of({"python": "^3.9", "Some.Lib": spec}) == [("some.lib", pin)]


def test_poetry_groups(spark):
    text = '[tool.poetry.dependencies]\npython = "^3.9"\na = "1.0"\n[tool.poetry.dev-dependencies]\nb = "^2"\n[tool.poetry.group.docs.dependencies]\nc = {version = "3.0"}\n[project]\ndependencies = ["d==4; python_version > \'3\'"]\n'
    got = {(r.package, r.version, r.is_direct) for r in code.declared_dependencies(tree_of(spark, {"pyproject.toml": text})).collect()}
    assert got == {("a", "1.0", True), ("b", None, True), ("c", "3.0", True), ("d", "4", True)}
