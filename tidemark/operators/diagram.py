"""Diagrams: edges lifted to what is visible, infrastructure from names and packages, the caller of the product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators import cycles

# File pairs shown with an edge; import edges beyond which weak ones are hidden.
FILE_PAIRS, WEAK_BEYOND = 20, 60
# Evidence and paths shown with an infrastructure node.
EVIDENCE, PATHS = 5, 10

# Fixed values: (id, category, label, kind of key, key, evidence). Names are in lower case.
PATH_RULES = [
    ("infra:docker", "container", "Docker", "name", "dockerfile", "Dockerfile present"),
    ("infra:docker", "container", "Docker", "start", "dockerfile.", "Dockerfile present"),
    ("infra:docker", "container", "Docker", "ending", ".dockerfile", "Dockerfile present"),
    ("infra:compose", "container", "Docker Compose", "name", "docker-compose.yml", "Compose file present"),
    ("infra:compose", "container", "Docker Compose", "name", "docker-compose.yaml", "Compose file present"),
    ("infra:compose", "container", "Docker Compose", "name", "compose.yml", "Compose file present"),
    ("infra:compose", "container", "Docker Compose", "name", "compose.yaml", "Compose file present"),
    ("infra:procfile", "deploy", "Procfile", "name", "procfile", "Procfile present"),
    ("infra:render", "deploy", "Render", "name", "render.yaml", "render.yaml present"),
    ("infra:vercel", "deploy", "Vercel", "name", "vercel.json", "vercel.json present"),
    ("infra:netlify", "deploy", "Netlify", "name", "netlify.toml", "netlify.toml present"),
    ("infra:fly", "deploy", "Fly.io", "name", "fly.toml", "fly.toml present"),
    ("infra:railway", "deploy", "Railway", "name", "railway.json", "Railway config present"),
    ("infra:railway", "deploy", "Railway", "name", "railway.toml", "Railway config present"),
    ("infra:helm", "deploy", "Helm chart", "name", "chart.yaml", "Helm Chart.yaml present"),
    ("infra:terraform", "deploy", "Terraform", "ending", ".tf", "Terraform files present"),
    ("infra:serverless", "deploy", "Serverless Framework", "name", "serverless.yml", "serverless.yml present"),
    ("infra:serverless", "deploy", "Serverless Framework", "name", "serverless.yaml", "serverless.yml present"),
    ("infra:github-actions", "ci", "GitHub Actions", "workflow", ".yml", ""),
    ("infra:github-actions", "ci", "GitHub Actions", "workflow", ".yaml", ""),
    ("infra:gitlab-ci", "ci", "GitLab CI", "path", ".gitlab-ci.yml", ".gitlab-ci.yml present"),
    ("infra:jenkins", "ci", "Jenkins", "name", "jenkinsfile", "Jenkinsfile present"),
    ("infra:circleci", "ci", "CircleCI", "path", ".circleci/config.yml", ".circleci/config.yml present"),
    ("infra:azure-pipelines", "ci", "Azure Pipelines", "name", "azure-pipelines.yml", "azure-pipelines.yml present"),
    ("infra:azure-pipelines", "ci", "Azure Pipelines", "name", "azure-pipelines.yaml", "azure-pipelines.yml present"),
]
# Datastores by the packages that talk to them.
STORES = {
    ("infra:postgresql", "PostgreSQL"): ["psycopg", "psycopg2", "psycopg2-binary", "psycopg-binary", "asyncpg", "pg", "postgres", "pg-promise", "postgresql"],
    ("infra:mysql", "MySQL"): ["mysqlclient", "pymysql", "mysql2", "mysql", "mysql-connector-python", "mysql-connector-j", "mysql-connector-java"],
    ("infra:mongodb", "MongoDB"): ["pymongo", "motor", "mongoose", "mongodb"],
    ("infra:redis", "Redis"): ["redis", "ioredis", "aioredis"],
}
# The nodes that start groups, and how the evidence of such an entry point begins.
RUNS = {"infra:docker": "Dockerfile", "infra:procfile": "Procfile"}
# Kinds of entry points that somebody starts, and the kind that counts where there are none.
CALLED, CALLED_ELSE = ["web_server", "ui_root", "cli"], "graph_inferred"


def owners(files: DataFrame, opened: DataFrame) -> DataFrame:
    """(path_id, owner): the nearest visible ancestor of each file.

    Top folders are visible, and so is what lies in an open folder that is visible itself. So a file
    belongs to the first folder of its path that is not open; where all are, and at the top, to itself.
    opened: folder.
    """
    seg = F.split("path", "/")
    above = files.select("path_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(seg) - 1), lambda k: F.array_join(F.slice(seg, F.lit(1), k), "/"))).alias("depth", "folder"))
    closed = above.where("depth > 0").join(opened.select("folder").distinct(), "folder", "left_anti")
    first = closed.groupBy("path_id").agg(F.min_by("folder", "depth").alias("folder"))
    return files.select("path_id", "path").join(first, "path_id", "left").select("path_id", F.coalesce("folder", "path").alias("owner"))


def first_of(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group, by a rank that Spark cuts before the shuffle."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n).drop("r")


def lifted(pairs: DataFrame, owner: DataFrame) -> DataFrame:
    """pairs (src, dst, ...) between different owners, with source and target."""
    a, b = owner.toDF("src", "source"), owner.toDF("dst", "target")
    return pairs.join(a, "src").join(b, "dst").where("source <> target")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(src, dst) of the edges within a strong component."""
    member = cycles.strong_components(edges)
    inner = edges.select("src", "dst").distinct().join(member.toDF("src", "a"), "src").join(member.toDF("dst", "b"), "dst")
    return inner.where("a = b").select("src", "dst")


def with_samples(rows: DataFrame, sums: DataFrame, n: int) -> DataFrame:
    """sums by source and target with file_pairs: the first n pairs of files behind each."""
    some = first_of(rows.select("source", "target", "src", "dst").distinct(), ["source", "target"], ["src", "dst"], n)
    pairs = some.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("file_pairs"))
    return sums.join(pairs, ["source", "target"])


def projected(imports: DataFrame, hidden: DataFrame, owner: DataFrame, samples: int = FILE_PAIRS, weak_beyond: int = WEAK_BEYOND) -> DataFrame:
    """kind, source, target, edges, in_cycle, max_degree, shared_revs, file_pairs, weak: edges summed between owners.

    imports: src, dst; hidden: a, b, degree, shared_revs, without a direction. An import edge is
    in_cycle if a file edge behind it lies on a cycle of files, or it lies on one of owners. With more
    than weak_beyond import edges, those of a single import that are on no cycle are weak, which a
    diagram hides and counts.
    """
    up = lifted(imports.select("src", "dst").distinct(), owner)
    by = ["source", "target"]
    of_files = up.join(on_cycles(imports).withColumn("round", F.lit(True)), ["src", "dst"], "left")
    sums = of_files.groupBy(*by).agg(F.count("*").alias("edges"), F.coalesce(F.bool_or("round"), F.lit(False)).alias("file_cycle"))
    of_owners = on_cycles(sums.select(F.col("source").alias("src"), F.col("target").alias("dst"))).toDF(*by).withColumn("owner_cycle", F.lit(True))
    one = with_samples(up, sums.join(of_owners, by, "left"), samples)
    none = F.lit(None)
    one = one.select(
        F.lit("import").alias("kind"), *by, "edges", (F.col("file_cycle") | F.coalesce("owner_cycle", F.lit(False))).alias("in_cycle"), none.cast("double").alias("max_degree"), none.cast("long").alias("shared_revs"), "file_pairs"
    )
    pairs = lifted(hidden.select(F.col("a").alias("src"), F.col("b").alias("dst"), "degree", "shared_revs"), owner)
    pairs = pairs.withColumns({"source": F.least("source", "target"), "target": F.greatest("source", "target")})
    two = pairs.groupBy(*by).agg(F.count("*").alias("edges"), F.max("degree").alias("max_degree"), F.sum("shared_revs").alias("shared_revs"))
    two = with_samples(pairs, two, samples).select(F.lit("hidden").alias("kind"), *by, "edges", F.lit(False).alias("in_cycle"), "max_degree", F.col("shared_revs").cast("long"), "file_pairs")
    many = one.agg((F.count("*") > weak_beyond).alias("many"))
    both = one.unionByName(two).crossJoin(F.broadcast(many))  # one row
    return both.withColumn("weak", F.col("many") & (F.col("kind") == "import") & (F.col("edges") < 2) & ~F.col("in_cycle")).drop("many")


def path_keys(path: Column) -> Column:
    """What rules look up of a path: its name, the whole path, its ending, its start up to a dot, its ending below the workflows' folder."""
    name, ending = F.lower(paths.basename(path)), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    key = lambda kind, value: F.struct(F.lit(kind).alias("key_kind"), value.alias("key"))
    found = F.array(
        key("name", name),
        key("path", path),
        key("ending", ending),
        key("start", F.when(F.contains(name, F.lit(".")), F.concat(F.substring_index(name, ".", 1), F.lit(".")))),
        key("workflow", F.when(F.startswith(path, F.lit(".github/workflows/")), ending)),
    )
    return F.filter(found, lambda x: x["key"].isNotNull())


def infrastructure(live: DataFrame, declared: DataFrame, entries: DataFrame, groups: DataFrame) -> DataFrame:
    """id, category, label, evidence, paths, runs_groups: one row for each piece of infrastructure that something speaks for.

    live: path; declared: ecosystem, package, path (of direct dependencies); entries: path, evidence;
    groups: path, grp. Rules, a fixed table, meet the keys of paths and packages by one join each; the
    first evidence and paths in order are kept.
    """
    spark = live.sparkSession
    rules = spark.createDataFrame(PATH_RULES, "id string, category string, label string, key_kind string, key string, evidence string")
    hits = live.select("path", F.explode(path_keys(F.col("path"))).alias("x")).select("path", "x.*").join(F.broadcast(rules), ["key_kind", "key"])
    hits = hits.select("id", "category", "label", "path", "evidence").distinct()
    flows = hits.where("id = 'infra:github-actions'").groupBy("id").agg(F.concat(F.count_distinct("path").cast("string"), F.lit(" workflow file(s) in .github/workflows")).alias("evidence"))
    packages = [(i, label, name) for (i, label), names in STORES.items() for name in names]
    stores = spark.createDataFrame(packages, "id string, label string, name string")
    plain = F.replace(F.lower("package"), F.lit("_"), F.lit("-"))
    name = F.when(F.col("ecosystem") == "Maven", F.element_at(F.split(plain, ":"), -1)).otherwise(plain)
    talks = declared.withColumn("name", name).join(F.broadcast(stores), "name")
    talks = talks.select("id", F.lit("datastore").alias("category"), "label", "path", F.concat(F.lit("declared dependency "), "package", F.lit(" in "), "path").alias("evidence"))
    both = hits.unionByName(talks)
    said = both.where("evidence <> ''").select("id", "evidence").unionByName(flows).distinct()
    nodes = both.select("id", "category", "label").distinct()
    listed = lambda rows, c, n: first_of(rows, ["id"], [c], n).groupBy("id").agg(F.array_sort(F.collect_list(c)).alias(c if c == "evidence" else "paths"))
    found = nodes.join(listed(said, "evidence", EVIDENCE), "id").join(listed(both.select("id", "path").distinct(), "path", PATHS), "id")
    begins = F.create_map(*[F.lit(x) for kv in RUNS.items() for x in kv])
    started = entries.join(groups, "path").select("evidence", "grp").withColumn("id", F.explode(F.map_keys(begins))).where(F.startswith("evidence", F.element_at(begins, F.col("id"))))
    runs = started.groupBy("id").agg(F.array_sort(F.collect_set("grp")).alias("runs_groups"))
    return found.join(runs, "id", "left").withColumn("runs_groups", F.coalesce("runs_groups", F.array().cast("array<string>")))


def actor(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """id, label, group_ids, entry_kinds: one row that points at the groups with an entry point that somebody starts, else at those inferred from the graph; none without either. entries: path, kind."""
    own = entries.join(groups, "path").where(F.col("kind").isin([*CALLED, CALLED_ELSE])).select("grp", "kind").distinct()
    strong = F.col("kind") != CALLED_ELSE
    some = own.agg(F.coalesce(F.bool_or(strong), F.lit(False)).alias("any_strong"))
    kept = own.crossJoin(F.broadcast(some)).where(strong | ~F.col("any_strong"))  # one row
    row = kept.agg(F.array_sort(F.collect_set("grp")).alias("group_ids"), F.array_sort(F.collect_set("kind")).alias("entry_kinds")).where(F.size("group_ids") > 0)
    return row.select(F.lit("actor").alias("id"), F.lit("Users & callers").alias("label"), "group_ids", "entry_kinds")
