"""Functions of repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension, layers and test folders by name.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".java": "java",
}
LAYERS = {
    "ui": ["ui", "view", "views", "component", "components", "page", "pages", "frontend"],
    "service": ["service", "services", "logic", "domain", "usecase", "usecases", "controller", "controllers", "api"],
    "db": ["db", "database", "model", "models", "repository", "repositories", "dao", "orm"],
}
LAYER_ORDER = {"ui": 0, "service": 1, "db": 2}
JS_TEST_DIRS = ["__tests__", "test", "tests", "e2e", "cypress"]


def segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def extension(path: Column) -> Column:
    """The last suffix with its dot in lower case; '' without one. A leading dot starts no suffix."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]+$", "$1")


def folder(path: Column) -> Column:
    """The parent folder; '' at the top."""
    seg = segments(path)
    return F.array_join(F.slice(seg, F.lit(1), F.size(seg) - 1), "/")


def ancestors(at: Column) -> Column:
    """A folder and all above it, from '' down."""
    seg = F.filter(segments(at), lambda s: s != "")
    return F.transform(F.sequence(F.lit(0), F.size(seg)), lambda k: F.array_join(F.slice(seg, F.lit(1), k), "/"))


def normal(path: Column) -> Column:
    """A relative path without empty parts, '.' and '..'; '..' at the top stays."""
    up = lambda kept: (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
    step = lambda kept, s: F.when(s.isin("", "."), kept).when((s == "..") & F.coalesce(up(kept), F.lit(False)), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(s)))
    return F.array_join(F.aggregate(segments(path), F.array().cast("array<string>"), step), "/")


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("other"))


def is_test(path: Column, lang: Column) -> Column:
    seg, name, st = segments(path), basename(path), stem(path)
    has = lambda names: F.arrays_overlap(seg, F.array(*[F.lit(n) for n in names]))
    py = has(["tests", "test"]) | (st == "conftest") | st.startswith("test_") | st.endswith("_test")
    js = F.contains(name, F.lit(".test.")) | F.contains(name, F.lit(".spec.")) | has(JS_TEST_DIRS)
    java = F.concat(F.lit("/"), path).contains("/src/test/") | st.rlike("(Test|Tests|IT)$")
    return F.when(lang == "python", py).when(lang.isin("javascript", "typescript"), js).when(lang == "java", java).otherwise(F.lit(False))


def layer(path: Column) -> Column:
    """ui, service or db by a folder's or the stem's name, in that order; null for neither."""
    seg = segments(path)
    words = F.transform(F.concat(F.slice(seg, 1, F.size(seg) - 1), F.array(stem(path))), F.lower)
    out = None
    for name, keys in LAYERS.items():
        hit = F.arrays_overlap(words, F.array(*[F.lit(k) for k in keys]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def directory(path: Column, depth: int = 3) -> Column:
    """The parent folder cut to `depth` segments; '(root)' at the top."""
    seg = segments(path)
    return F.when(F.size(seg) == 1, F.lit("(root)")).otherwise(F.array_join(F.slice(seg, 1, F.least(F.size(seg) - 1, F.lit(depth))), "/"))


# Folders of samples, and files about the project itself.
SAMPLE_DIRS = ["examples", "example", "fixtures", "fixture"]
PROJECT_FILES = """
    readme readme.md readme.rst readme.txt history.md history.rst history.txt changes.md changelog changelog.md changelog.rst
    changelog.txt license license.md license.txt licence licence.md licence.txt contributing.md contributing.rst package.json
    package-lock.json yarn.lock pnpm-lock.yaml pyproject.toml poetry.lock pipfile pipfile.lock requirements.txt setup.py
    setup.cfg dockerfile docker-compose.yml docker-compose.yaml makefile procfile gemfile gemfile.lock
""".split()


def is_non_source(path: Column, test: Column) -> Column:
    """Tests, samples, dotted files and folders, and files about the project itself."""
    odd = F.arrays_overlap(segments(path), F.array(*[F.lit(x) for x in SAMPLE_DIRS]))
    dotted = F.exists(segments(path), lambda s: s.startswith("."))
    return test | odd | dotted | F.lower(basename(path)).isin(PROJECT_FILES)


def clean_reference(value: Column) -> Column:
    """A path as manifests write it: no quotes, and no leading characters '.' and '/'."""
    return F.ltrim(F.trim(F.trim(value), F.lit("'\"")), F.lit("./"))


def tokens(name: Column) -> Column:
    """Lower-case words of camelCase, PascalCase, snake_case and kebab-case names."""
    spaced = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[^a-zA-Z0-9]+", " ")), " "), lambda w: w != "")
