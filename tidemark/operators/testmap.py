"""Which test stands for which source, and which sources have none or an idle one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators.tables import saved

# A test is idle below this share of its source's changes, from so many commits on.
IDLE_BELOW, LEAST_COMMITS = 0.2, 5
#: How a test is tied to a source, the surest first.
RULES = ["mirror", "stem", "import"]


def pointed_at(tests: DataFrame) -> DataFrame:
    """(test_id, language, path, stem): the source that a test's name points at, where it follows a convention of its language.

    tests: path_id, language, name, stem, home. Python names lose test_ or _test, script names .test or
    .spec, Java names Tests, Test or IT; Java sources lie below src/main where tests lie below src/test.
    """
    at = lambda folder, file: F.ltrim(F.concat_ws("/", folder, file), F.lit("/"))

    def asked(rows: DataFrame, stem: Column, path: Column) -> DataFrame:
        return rows.withColumn("own", stem).where("own <> ''").select(F.col("path_id").alias("test_id"), "language", path.alias("path"), F.col("own").alias("stem"))

    python = F.when(F.startswith("stem", F.lit("test_")), F.substring(F.col("stem"), F.lit(6), F.length("stem"))).otherwise(F.regexp_extract("stem", "^(.+)_test$", 1))
    ending = F.regexp_extract("name", r"^.+(\.[^.]+)$", 1)
    infix = F.when(F.contains("name", F.lit(".test.")), ".test.").otherwise(".spec.")
    first = F.instr("name", infix)
    cut = F.when(first > 0, F.concat(F.substring(F.col("name"), F.lit(1), first - 1), F.substring(F.col("name"), first + F.length(infix) - 1, F.length("name"))))
    scripts = tests.where(F.col("language").isin("javascript", "typescript")).withColumn("name", cut).where("name is not null")
    script = F.regexp_replace("name", r"^(.+)\.[^.]+$", "$1")
    java = F.regexp_extract("stem", "^(.*?)(Tests|Test|IT)$", 1)
    found = asked(tests.where("language = 'python'"), python, at(F.col("home"), F.concat("own", ending)))
    found = found.unionByName(asked(scripts, script, at(F.col("home"), F.col("name"))))
    java_home = F.regexp_replace("home", "^src/test(?=/|$)", "src/main")
    return found.unionByName(asked(tests.where("language = 'java'"), java, at(java_home, F.concat("own", F.lit(".java")))))


def test_map(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(test_id, source_id, rule), each pair once by its surest rule.

    files: path_id, path of live files; edges: src, dst. mirror: the path that the test's name points at
    is a source; stem: no such path, but just one source of the language has that stem; import: the
    test imports the source. A stem that several sources share says nothing.
    """
    path, lang = F.col("path"), paths.language(F.col("path"))
    # Written once: what it derives from a path is asked for many times.
    own = saved(files.select("path_id", "path", lang.alias("language"), paths.is_test(path, lang).alias("is_test"), paths.basename(path).alias("name"), paths.stem(path).alias("stem"), paths.folder(path).alias("home")))
    tests, sources = own.where("is_test"), own.where("not is_test")
    asked = pointed_at(tests)
    mirror = asked.join(sources.select("path", F.col("path_id").alias("source_id")), "path").select("test_id", "source_id", F.lit(1).alias("no"))
    stems = sources.groupBy("language", "stem").agg(F.count("*").alias("n"), F.min("path_id").alias("source_id")).where("n = 1")
    stem = asked.join(mirror, "test_id", "left_anti").join(stems, ["language", "stem"]).select("test_id", "source_id", F.lit(2).alias("no"))
    by_import = edges.select(F.col("src").alias("test_id"), F.col("dst").alias("source_id")).join(tests.select(F.col("path_id").alias("test_id")), "test_id", "left_semi")
    by_import = by_import.join(sources.select(F.col("path_id").alias("source_id")), "source_id", "left_semi").select("test_id", "source_id", F.lit(3).alias("no"))
    every = mirror.unionByName(stem).unionByName(by_import).groupBy("test_id", "source_id").agg(F.min("no").alias("no"))
    return every.select("test_id", "source_id", F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("no")).alias("rule"))


def test_gaps(files: DataFrame, tests: DataFrame, touches: DataFrame) -> DataFrame:
    """(path_id, classification, ratio, tests) of every live source: no_test, stale_test or tracked.

    files: path_id, path, commit_count; tests: as test_map gives them; touches: commit_id, path_id. ratio
    is the share of a source's commits that touch one of its tests too, null without a test. Too few
    commits are never called stale.
    """
    lang = paths.language(F.col("path"))
    sources = files.where(~paths.is_test(F.col("path"), lang)).select("path_id", "commit_count")
    tied = tests.select("test_id", F.col("source_id").alias("path_id")).distinct()
    counts = tied.groupBy("path_id").agg(F.count("*").alias("tests"))
    own = touches.select("commit_id", "path_id").distinct().join(counts.select("path_id"), "path_id", "left_semi")
    along = touches.select("commit_id", F.col("path_id").alias("test_id")).distinct().join(tied, "test_id").select("commit_id", "path_id").distinct().withColumn("along", F.lit(1))
    ratios = own.join(along, ["commit_id", "path_id"], "left").groupBy("path_id").agg((F.count("along") / F.count("*")).alias("ratio"))
    rows = sources.join(counts, "path_id", "left").join(ratios, "path_id", "left")
    ratio = F.when(F.col("tests").isNotNull(), F.coalesce("ratio", F.lit(0.0)))
    kind = F.when(ratio.isNull(), "no_test").when((ratio < IDLE_BELOW) & (F.col("commit_count") >= LEAST_COMMITS), "stale_test").otherwise("tracked")
    return rows.select("path_id", kind.alias("classification"), ratio.alias("ratio"), F.coalesce("tests", F.lit(0)).cast("long").alias("tests"))
