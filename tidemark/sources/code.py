"""Imports, symbols, complexity and manifests of source files: Arrow batches in, rows out.

Parsers emit candidates in order of priority; a join with the tree's paths decides which is real, so
no task holds the whole tree.
"""

from __future__ import annotations

import ast
import json
import posixpath
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tables import saved
from tidemark.sources import aliases, requirements

BRANCHES = {
    "python": r"\b(?:if|elif|for|while|except|and|or|assert|case)\b|\bif\b",
    "other": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])",
}
JS_IMPORT = re.compile(r"""(?:^|[;\s])(?:import|export)\s(?:[^'"();]*?\sfrom\s*)?['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]\s*\)|\bimport\(\s*['"]([^'"]+)['"]\s*\)""")
JAVA_IMPORT = re.compile(r"^\s*import\s+(static\s+)?([\w.]+)(\.\*)?\s*;", re.M)
JS_ENDINGS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs")


def python_candidates(path: str, text: str) -> list[tuple[int, int, str]]:
    """(import number, priority, path) for the imports of a Python file; none where it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out, n, here = [], 0, posixpath.dirname(path)

    def add(targets):
        nonlocal n
        n += 1
        out.extend((n, i, p) for i, p in enumerate(targets))

    def files(module: str):
        return [f"{module}.py", f"{module}/__init__.py"]

    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                add(files(a.name.replace(".", "/")))
        elif isinstance(node, ast.ImportFrom):
            base = (node.module or "").replace(".", "/")
            if node.level:
                up = here
                for _ in range(node.level - 1):
                    up = posixpath.dirname(up)
                base = posixpath.join(up, base).rstrip("/")
            for a in node.names:  # a submodule before the module itself
                add([*files(f"{base}/{a.name}".lstrip("/")), *files(base)])
    return out


def js_specifiers(path: str, text: str) -> list[tuple[int, str, str, bool]]:
    """(import number, kind, path or name, whether it is a name): relative paths from the tree's top, without the ending that may be missing."""
    out = []
    for n, m in enumerate(JS_IMPORT.finditer(text)):
        spec, kind = next(x for x in m.groups() if x), "dynamic" if m[3] else "static"
        if spec.startswith("."):
            out.append((n, kind, posixpath.normpath(posixpath.join(posixpath.dirname(path), spec)), False))
        elif spec.startswith("/"):
            out.append((n, kind, posixpath.normpath(spec.lstrip("/")), False))
        else:
            out.append((n, kind, spec, True))
    return out


def js_tried(base: Column) -> Column:
    """The files that a path without its ending may name, the first that exists counts."""
    ends = F.array(*[F.lit(e) for e in ["", *JS_ENDINGS, *[f"/index{e}" for e in JS_ENDINGS]]])
    swaps = F.when(base.rlike(r"\.(m?js|jsx)$"), F.transform(F.array(*[F.lit(e) for e in (".ts", ".tsx", ".mts")]), lambda e: F.concat(F.regexp_replace(base, r"\.m?jsx?$", ""), e)))
    return F.concat(F.transform(ends, lambda e: F.concat(base, e)), F.coalesce(swaps, F.array().cast("array<string>")))


def script_imports(tree: DataFrame) -> DataFrame:
    """(src, import_no, kind, priority, target): relative imports, and names by the aliases of the nearest configuration."""
    scripts = tree.where(F.lower("path").rlike(r"\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$"))
    found = parsed(scripts, js_specifiers, ["import_no", "kind", "spec", "is_name"], "import_no int, kind string, spec string, is_name boolean").withColumnRenamed("path", "src")
    configs = aliases.configurations(parsed(tree.where(F.col("path").rlike(r"(^|/)(ts|js)config[^/]*\.json$")), aliases.config_of, ["extends", "base", "paths"], "extends string, base string, paths string"))
    named = aliases.aliased(found.where("is_name"), configs).select("src", "import_no", "kind", "base", "rank")
    both = found.where("not is_name").select("src", "import_no", "kind", F.col("spec").alias("base"), F.lit(0).alias("rank")).unionByName(named)
    each = both.select("src", "import_no", "kind", "rank", F.posexplode(js_tried(F.col("base"))).alias("no", "target"))
    return each.select("src", "import_no", "kind", (F.col("rank") * 100 + F.col("no")).alias("priority"), "target")


def java_candidates(text: str) -> list[tuple[int, int, str]]:
    """Class imports as path endings; a wildcard as its folder with '/*'."""
    out = []
    for n, m in enumerate(JAVA_IMPORT.finditer(text)):
        name = m[2].rsplit(".", 1)[0] if m[1] and not m[3] else m[2]
        out.append((n, 0, name.replace(".", "/") + ("/*" if m[3] and not m[1] else ".java")))
    return out


def import_candidates(tree: DataFrame) -> DataFrame:
    """tree (path, content) -> src, language, import_no, kind, priority, target."""

    def parse(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["content"].fillna(""), strict=True):
                lang, found = ("python", python_candidates(path, text)) if path.endswith(".py") else ("java", java_candidates(text))
                out += [(path, lang, n, i, t) for n, i, t in found]
            yield pd.DataFrame(out, columns=["src", "language", "import_no", "priority", "target"])

    others = tree.where(F.col("path").rlike(r"\.(py|java)$")).select("path", "content").mapInPandas(parse, "src string, language string, import_no int, priority int, target string")
    return others.withColumn("kind", F.lit("static")).unionByName(script_imports(tree).withColumn("language", F.lit("javascript")))


def import_edges(tree: DataFrame, wildcard: int = 50) -> DataFrame:
    """(src, dst, language, kind) once each, without edges to the file itself; what is not in the tree is dropped.

    kind (static or dynamic) is that of the first import of dst in src. Java classes are found by any
    ending of a path at a folder's edge; a wildcard reaches the first `wildcard` files of its folder in
    order.
    """
    found = import_candidates(tree)
    here = tree.select(F.col("path").alias("dst"))
    exact = found.where("language <> 'java'").join(here.withColumn("target", F.col("dst")), "target")
    best = exact.groupBy("src", "language", "import_no", "kind").agg(F.min_by("dst", "priority").alias("dst"))
    parts = F.split("dst", "/")
    java = here.where(F.col("dst").endswith(".java"))
    ends = java.select("dst", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))).alias("target"))
    classes = found.where("language = 'java' and not endswith(target, '/*')").join(ends, "target").groupBy("src", "language", "import_no", "kind").agg(F.min("dst").alias("dst"))
    folders = ends.select("dst", F.concat(F.regexp_replace("target", "/[^/]*$", ""), F.lit("/*")).alias("target")).where("target <> '/*' and contains(target, '/')").distinct()
    w = Window.partitionBy("src", "import_no").orderBy("dst")
    wild = found.where("language = 'java' and endswith(target, '/*')").join(folders, "target").withColumn("r", F.row_number().over(w)).where(F.col("r") <= wildcard)
    own = ["src", "dst", "language", "import_no", "kind"]
    rows = best.select(*own).unionByName(classes.select(*own)).unionByName(wild.select(*own))
    return rows.where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("import_no", "language", "kind")).alias("x")).select("src", "dst", "x.language", "x.kind")


JS_SYMBOL = re.compile(r"^(\s*)(export\s+(?:default\s+)?)?(?:abstract\s+|async\s+|declare\s+)*(class|function|interface|type|enum|const)\s+([A-Za-z_$][\w$]*)", re.M)
JAVA_METHOD = re.compile(r"^[ \t]*((?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*)(?:<[^>]+>\s+)?(?!return\b|new\b|else\b|throw\b|package\b|import\b)[\w.$]+(?:<[^;{}()]*>)?(?:\[\])*\s+(\w+)\s*\([^;{}()]*\)\s*(?:throws\s+[\w.,\s]+)?[{;]", re.M)
JAVA_SYMBOL = re.compile(r"^\s*((?:public|private|protected|static|final|abstract|sealed)\s+)*(class|interface|enum|record)\s+(\w+)", re.M)


def symbols_of(path: str, text: str) -> list[tuple[str, str, int, bool]]:
    """(name, kind, line, exported) of the declarations in a file, nested ones and Java methods too; enums and records are classes."""
    at = lambda m: text.count("\n", 0, m.start(m.lastindex)) + 1
    if path.endswith(".py"):
        try:
            body = [*ast.walk(ast.parse(text))]
        except (SyntaxError, ValueError, RecursionError):
            return []
        kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}
        return sorted(((n.name, kinds[type(n)], n.lineno, not n.name.startswith("_")) for n in body if type(n) in kinds), key=lambda x: (x[2], x[0]))
    if path.endswith((".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts")):
        return [(m[4], m[3], at(m), bool(m[2])) for m in JS_SYMBOL.finditer(text) if not m[1]]
    if path.endswith(".java"):
        types = [(m[3], "interface" if m[2] == "interface" else "class", at(m), "public" in m[0]) for m in JAVA_SYMBOL.finditer(text)]
        methods = [(m[2], "method", at(m), "public" in m[1]) for m in JAVA_METHOD.finditer(text)]
        return sorted(types + methods, key=lambda x: (x[2], x[0]))
    return []


def complexity_of(path: str, text: str) -> tuple[int, int]:
    """(lines of code, the greatest cyclomatic complexity of a function): 0 and 0 beyond a megabyte or where a file does not parse."""
    if len(text) > 1_000_000:
        return 0, 0
    code = [s for line in text.splitlines() if (s := line.strip()) and not s.startswith(("#", "//", "*", "/*"))]
    if path.endswith(".py"):
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return 0, 0
        one = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension, ast.match_case)
        functions = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        score = lambda f: 1 + sum(isinstance(n, one) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(f))
        return len(code), max(map(score, functions), default=0)
    bodies, depth, start = [], 0, None
    for m in re.finditer(r"(\)\s*(?:=>\s*)?\{)|[{}]", text):
        if m[0] == "}":
            depth -= 1
            if start is not None and depth == start[1]:
                bodies.append(text[start[0] : m.start()])
                start = None
        else:
            if m[1] and start is None:
                start = (m.start(), depth)
            depth += 1
    return len(code), max((1 + len(re.findall(BRANCHES["other"], b)) for b in bodies), default=0)


def parsed(tree: DataFrame, function, columns: list[str], schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["content"].fillna(""), strict=True):
                found = function(path, text)
                out += [(path, *r) for r in (found if isinstance(found, list) else [found])]
            yield pd.DataFrame(out, columns=["path", *columns])

    return tree.select("path", "content").mapInPandas(run, f"path string, {schema}")


def symbols(tree: DataFrame) -> DataFrame:
    return parsed(tree, symbols_of, ["name", "kind", "line", "exported"], "name string, kind string, line int, exported boolean")


def complexity(tree: DataFrame) -> DataFrame:
    return parsed(tree, complexity_of, ["loc", "complexity"], "loc int, complexity int")


PINNED = re.compile(r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:==\s*([A-Za-z0-9.!+_-]+))?")
EXACT = re.compile(r"^={0,3}\s*(\d[\w.+!-]*)$")


def poetry_of(table: dict) -> list[tuple[str, str | None]]:
    """(package, version if pinned) of a Poetry table: a bare number pins, a caret, tilde, range or source does not; python itself is none."""
    out = []
    for name, spec in table.items():
        wanted = spec.get("version") if isinstance(spec, dict) else spec
        pin = EXACT.match(wanted.strip()) if isinstance(wanted, str) else None
        if name.lower() != "python":
            out.append((name.lower(), pin[1] if pin else None))
    return out


def declared_of(path: str, text: str) -> list[tuple[str, str, str | None, bool]]:
    """(ecosystem, package, version if pinned, is_direct); a manifest that does not parse declares nothing.

    Requirement files are read by `requirements`, as they include others.
    """
    name = posixpath.basename(path)
    try:
        if name == "pyproject.toml":
            data = tomllib.loads(text)
            rows = [("PyPI", m[1].lower(), m[2], True) for s in data.get("project", {}).get("dependencies", []) if (m := PINNED.match(s.split(";")[0].replace(" ", "")))]
            poetry = data.get("tool", {}).get("poetry", {})
            tables = [poetry.get("dependencies", {}), poetry.get("dev-dependencies", {}), *(g.get("dependencies", {}) for g in poetry.get("group", {}).values())]
            return rows + [("PyPI", n, v, True) for t in tables for n, v in poetry_of(t)]
        if name == "package-lock.json":
            lock = json.loads(text)
            if "packages" in lock:  # versions 2 and 3
                direct = {*lock["packages"].get("", {}).get("dependencies", {}), *lock["packages"].get("", {}).get("devDependencies", {})}
                own = {k.rsplit("node_modules/", 1)[-1]: (k, v) for k, v in lock["packages"].items() if k}
                return [("npm", n, v.get("version"), n in direct and k.count("node_modules/") == 1) for n, (k, v) in own.items()]
            out: list[tuple[str, str, str | None, bool]] = []

            def walk(deps, top):
                for n, v in deps.items():
                    out.append(("npm", n, v.get("version"), top))
                    walk(v.get("dependencies", {}), False)

            walk(lock.get("dependencies", {}), True)
            return out
        if name == "pom.xml":
            import xml.etree.ElementTree as ET

            if "<!ENTITY" in text:
                return []
            root = ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
            props = {p.tag: (p.text or "").strip() for p in root.findall("./properties/*")}
            fill = lambda v: re.sub(r"\$\{([^}]+)\}", lambda m: props.get(m[1], m[0]), v)
            rows = []
            for d in root.findall("./dependencies/dependency"):
                v = fill((d.findtext("version") or "").strip())
                rows.append(("Maven", f"{d.findtext('groupId')}:{d.findtext('artifactId')}", None if not v or "$" in v or v[0] in "[(" else v, True))
            return rows
    except Exception:  # noqa: BLE001  any damage in a manifest means that it declares nothing
        return []
    return []


def declared_dependencies(tree: DataFrame) -> DataFrame:
    """(path, ecosystem, package, version, is_direct, declared_in) of every manifest; declared_in differs from path where a requirement file includes another."""
    others = parsed(tree.where(~F.col("path").endswith(".txt")), declared_of, ["ecosystem", "package", "version", "is_direct"], "ecosystem string, package string, version string, is_direct boolean")
    lines = saved(parsed(tree.where(F.col("path").endswith(".txt")), requirements.lines_of, ["line", "kind", "name", "version"], "line int, kind string, name string, version string"))
    roots = tree.where(F.col("path").rlike(r"(^|/)requirements[^/]*\.txt$")).select("path")
    pip = requirements.required(lines, roots)
    return others.withColumn("declared_in", F.col("path")).unionByName(pip.select("path", F.lit("PyPI").alias("ecosystem"), "package", "version", F.lit(True).alias("is_direct"), "declared_in"))


def unique_dependencies(declared: DataFrame) -> DataFrame:
    """Pinned dependencies once each; direct if any manifest says so."""
    return declared.where("version is not null").groupBy("ecosystem", "package", "version").agg(F.bool_or("is_direct").alias("is_direct"))


# Phrases that tell licences apart, the longer before the shorter.
LICENSES = [
    ("Apache License", "Apache-2.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE", "AGPL-3.0"), ("GNU LESSER GENERAL PUBLIC LICENSE", "LGPL-3.0"), ("GNU GENERAL PUBLIC LICENSE", "GPL-3.0"),
    ("Mozilla Public License", "MPL-2.0"), ("Permission is hereby granted, free of charge", "MIT"), ("Redistribution and use in source and binary forms", "BSD-3-Clause"), ("This is free and unencumbered software", "Unlicense"),
]


def license_of(text: str) -> str | None:
    """The identifier of a well-known licence by a phrase of its text."""
    flat = " ".join(text.split()).lower()
    return next((name for phrase, name in LICENSES if phrase.lower() in flat), None)


def _manifest_fields(name: str, text: str) -> tuple[str, dict] | None:
    if name == "package.json":
        data = json.loads(text)
        return "package_json", {k: data[k] for k in ("name", "main", "bin", "scripts", "module") if k in data}
    if name == "pyproject.toml":
        data = tomllib.loads(text)
        project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
        return "pyproject", {"name": project.get("name") or poetry.get("name"), "scripts": {**poetry.get("scripts", {}), **project.get("scripts", {})}}
    if name == "setup.py":
        # Literals only: nothing of the file is run.
        calls = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call) and getattr(n.func, "id", getattr(n.func, "attr", "")) == "setup"]
        found = {}
        for k in (k for c in calls for k in c.keywords if k.arg in ("name", "entry_points", "scripts")):
            try:
                found[k.arg] = ast.literal_eval(k.value)
            except ValueError:
                continue
        return "setup_py", found
    if name == "pom.xml":
        if "<!ENTITY" in text:
            return None
        import xml.etree.ElementTree as ET

        root = ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
        return "pom_xml", {"artifactId": root.findtext("artifactId"), "mainClass": next((e.text.strip() for e in root.iter("mainClass") if e.text), None)}
    if name in ("build.gradle", "build.gradle.kts"):
        m = re.search(r"""mainClass(?:Name)?(?:\.set\(|\s*=)\s*['"]([\w.$]+)['"]""", text)
        return "build_gradle", {"mainClass": m[1] if m else None}
    if re.fullmatch(r"requirements.*\.txt", name):
        return "requirements", {"lines": sum(bool(s.strip()) and not s.strip().startswith("#") for s in text.splitlines())}
    if name == "Dockerfile":
        return "dockerfile", {"commands": re.findall(r"^(?:CMD|ENTRYPOINT)\s+(.+)$", text, re.M)}
    if name == "Procfile":
        return "procfile", {"processes": dict(re.findall(r"^(\w+):\s*(.+)$", text, re.M))}
    if name.lower().startswith("readme"):
        heading = re.search(r"^#+\s+(.+?)\s*#*$", text, re.M)
        return "readme", {"lines": text.count("\n") + 1, "heading": heading[1] if heading else next((s.strip() for s in text.splitlines() if s.strip()), None)}
    if name.lower().startswith(("license", "licence")):
        return "license", {"first": text.strip().split("\n")[0][:120], "id": license_of(text)}
    return None


def manifest_of(path: str, text: str) -> list[tuple[str, str]]:
    """(kind, named fields as JSON); a file that is no manifest, or does not parse, gives none."""
    try:
        found = _manifest_fields(posixpath.basename(path), text)
        return [(found[0], json.dumps(found[1], sort_keys=True))] if found else []
    except (ValueError, TypeError, KeyError, AttributeError, SyntaxError, RecursionError):
        return []


def manifests(tree: DataFrame) -> DataFrame:
    """path, kind, data (VARIANT)."""
    rows = parsed(tree, manifest_of, ["kind", "json"], "kind string, json string")
    return rows.select("path", "kind", F.try_parse_json("json").alias("data"))


def advisories_for(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies with the advisories of their package and version, from a table of known advisories."""
    from tidemark.functions.numbers import cvss_band, cvss_base

    rows = dependencies.join(advisories, ["ecosystem", "package", "version"])
    return rows.withColumn("score", cvss_base(F.col("vector"))).withColumn("band", F.when(F.col("score").isNotNull(), cvss_band(F.col("score"))))
