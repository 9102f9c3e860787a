"""Projections of paths, messages, names and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.bindings import bind, oracle
from tidemark.functions import numbers, paths, texts
from tidemark.registry import query

NAME = "list_last(string_split(path, '/'))"
EXT = f"lower(regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1))"
STEM = f"regexp_replace({NAME}, '^(.+)\\.[^.]+$', '\\1')"
LANG = f"CASE {EXT} WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.java' THEN 'java' ELSE 'other' END"
IS_TEST = f"""CASE {LANG} WHEN 'python' THEN regexp_matches('/' || path, '/(tests|test)/') OR {STEM} = 'conftest' OR starts_with({STEM}, 'test_') OR ends_with({STEM}, '_test')
    WHEN 'java' THEN contains('/' || path, '/src/test/') OR regexp_matches({STEM}, '(Test|Tests|IT)$') WHEN 'other' THEN false
    ELSE contains({NAME}, '.test.') OR contains({NAME}, '.spec.') OR regexp_matches('/' || path, '/(__tests__|test|tests|e2e|cypress)(/|$)') END"""
LAYER = f"""CASE WHEN list_has_any(list_concat(string_split(lower(path), '/')[:-2], [lower({STEM})]), ['ui','view','views','component','components','page','pages','frontend']) THEN 'ui'
    WHEN list_has_any(list_concat(string_split(lower(path), '/')[:-2], [lower({STEM})]), ['service','services','logic','domain','usecase','usecases','controller','controllers','api']) THEN 'service'
    WHEN list_has_any(list_concat(string_split(lower(path), '/')[:-2], [lower({STEM})]), ['db','database','model','models','repository','repositories','dao','orm']) THEN 'db' END"""


@query(oracle("file7", f"SELECT path_id, path, {LANG} AS language FROM file7"))
def prj_language(spark, sf_dir):
    return bind(spark, sf_dir, "file7").select("path_id", "path", paths.language(F.col("path")).alias("language"))


@query(oracle("file7", f"SELECT path_id, {IS_TEST} AS is_test FROM file7"))
def prj_is_test(spark, sf_dir):
    return bind(spark, sf_dir, "file7").select("path_id", paths.is_test(F.col("path"), paths.language(F.col("path"))).alias("is_test"))


@query(oracle("file7", f"SELECT path_id, {LAYER} AS layer FROM file7"))
def prj_layer(spark, sf_dir):
    return bind(spark, sf_dir, "file7").select("path_id", paths.layer(F.col("path")).alias("layer"))


@query(oracle("file7", "SELECT path_id, CASE WHEN contains(path, '/') THEN array_to_string(string_split(path, '/')[:-2][1:3], '/') ELSE '(root)' END AS directory FROM file7"))
def prj_directory(spark, sf_dir):
    return bind(spark, sf_dir, "file7").select("path_id", paths.directory(F.col("path")).alias("directory"))


NON_SOURCE = f"""({IS_TEST}) OR list_has_any(string_split(path, '/'), {paths.SAMPLE_DIRS}) OR regexp_matches('/' || path, '/\\.') OR lower({NAME}) IN ({", ".join(f"'{x}'" for x in paths.PROJECT_FILES)})"""


@query(oracle("file7", f"SELECT path_id, {NON_SOURCE} AS non_source FROM file7"))
def prj_non_source(spark, sf_dir):
    files = bind(spark, sf_dir, "file7")
    test = paths.is_test(F.col("path"), paths.language(F.col("path")))
    return files.select("path_id", paths.is_non_source(F.col("path"), test).alias("non_source"))


MESSAGES = "concat(p_type, CASE p_partkey % 9 WHEN 0 THEN ' fixes it' WHEN 1 THEN ' Fix #12' WHEN 2 THEN ' closed' WHEN 3 THEN ' bug: x' WHEN 4 THEN ' close #7' ELSE '' END)"
PARTS = f"SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN concat('  Revert ', p_name) ELSE {MESSAGES} END AS message FROM "


@query(f"SELECT p_partkey, regexp_matches(message, '(?i)\\b(fix|bug|patch|resolve|close[sd]?)\\b') AS is_fix, regexp_matches(message, '(?i)^\\s*revert\\b') AS is_revert FROM ({PARTS} part)")
def prj_is_fix(spark, sf_dir):
    rows = spark.sql(PARTS + "{part}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return rows.select("p_partkey", texts.is_fix(F.col("message")).alias("is_fix"), texts.is_revert(F.col("message")).alias("is_revert"))


@query(f"""SELECT p_partkey, CASE WHEN NOT regexp_matches(message, '(?i)\\b(fix|bug|patch|resolve|close[sd]?)\\b') THEN 0.0::DOUBLE WHEN regexp_matches(message, '#[0-9]+') THEN 1.0::DOUBLE
    WHEN regexp_matches(message, '(?i)\\b(fix|bug|patch|resolve)\\b') THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM ({PARTS} part)""")
def prj_fix_confidence(spark, sf_dir):
    rows = spark.sql(PARTS + "{part}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return rows.select("p_partkey", texts.fix_confidence(F.col("message")).alias("confidence"))


@query("SELECT c_custkey, CASE WHEN n <= 20 THEN 'small' WHEN n <= 200 THEN 'medium' ELSE 'large' END AS bucket FROM (SELECT c_custkey, c_custkey % 400 AS n FROM customer)")
def prj_size_bucket(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", numbers.size_bucket(F.col("c_custkey") % 400).alias("bucket"))


@query("SELECT l_orderkey, l_linenumber, l_discount * 10 AS value, CASE WHEN l_discount * 10 >= 0.7 THEN 'high' WHEN l_discount * 10 >= 0.4 THEN 'med' ELSE 'low' END AS severity FROM lineitem")
def prj_severity(spark, sf_dir):
    value = F.col("l_discount") * 10
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", value.alias("value"), numbers.severity(value, 0.70, 0.40).alias("severity"))


@query(oracle("file7", "SELECT path_id, substr(sha256('risk:' || path), 1, 32) AS signature FROM file7"))
def prj_signature(spark, sf_dir):
    return bind(spark, sf_dir, "file7").select("path_id", texts.signature("risk", F.col("path")).alias("signature"))


@query(oracle("people", "SELECT DISTINCT email, CASE WHEN email = '' THEN '' ELSE substr(string_split(email, '@')[1], 1, 1) || '***@' || string_split(email, '@')[2] END AS masked FROM people"))
def prj_mask_email(spark, sf_dir):
    return bind(spark, sf_dir, "people").select("email", texts.mask_email(F.col("email")).alias("masked")).distinct()


@query("SELECT p_partkey, CASE WHEN length(trim(p_name)) >= 12 THEN substr(trim(p_name), 1, 4) || repeat('*', 16) || right(trim(p_name), 2) END AS preview FROM part")
def prj_redact(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", texts.redact(F.col("p_name")).alias("preview"))


@query("SELECT p_partkey, sha256('salt:generic:' || trim(p_name)) AS fingerprint FROM part")
def fn_fingerprint(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", texts.fingerprint("salt", F.lit("generic"), F.col("p_name")).alias("fingerprint"))


@query("""SELECT p_partkey, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM (SELECT p_partkey, ch, count(*)::DOUBLE AS c, any_value(n)::DOUBLE AS n
    FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch, length(p_name) AS n FROM part) GROUP BY 1, 2) GROUP BY 1""")
def fn_entropy(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(texts.entropy(F.col("p_name")), 6).alias("entropy"))


@query(f"""SELECT path_id, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({STEM.replace("path", "f.path")}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS words
    FROM ({oracle("file7", "SELECT * FROM file7")}) f""")
def fn_tokenizer(spark, sf_dir):
    return bind(spark, sf_dir, "file7").select("path_id", paths.tokens(paths.stem(F.col("path"))).alias("words"))


@query("SELECT p_partkey, ltrim(trim(trim('\"./' || p_name || '\"'), '''\"'), './') AS path FROM part")
def fn_clean_reference(spark, sf_dir):
    raw = F.concat(F.lit('"./'), F.col("p_name"), F.lit('"'))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", paths.clean_reference(raw).alias("path"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def fn_parse_time(spark, sf_dir):
    """Every other stamp has an offset that cannot be: it counts as UTC."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+00:00").otherwise("+518:00"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format(texts.parse_time(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT event_id, CASE WHEN v <= 0 THEN 0 ELSE least(ceil(5 * sqrt(v / m)), 5) END::INTEGER AS bucket FROM (SELECT event_id, value AS v, max(value) OVER () AS m FROM events)")
def fn_activity_bucket(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    most = events.agg(F.max("value").alias("m"))
    bucket = F.when(F.col("value") <= 0, 0).otherwise(numbers.activity_bucket(F.col("value"), F.col("m"))).cast("int")
    return events.crossJoin(F.broadcast(most)).select("event_id", bucket.alias("bucket"))


VECTOR = """concat('CVSS:3.1/AV:', CASE p_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'L' ELSE 'P' END, '/AC:', CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'H' END,
    '/PR:', CASE p_partkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END, '/UI:', CASE WHEN p_size % 3 = 0 THEN 'N' ELSE 'R' END, '/S:', CASE WHEN p_size % 5 = 0 THEN 'C' ELSE 'U' END,
    '/C:', CASE p_size % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END, '/I:', CASE p_partkey % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END, CASE WHEN p_partkey % 29 = 0 THEN '' ELSE '/A:H' END)"""


CVSS_SQL = f"""WITH v AS (SELECT p_partkey, {VECTOR} AS vector, p_partkey % 29 = 0 AS bad,
      [0.85, 0.62, 0.55, 0.20][p_partkey % 4 + 1]::DOUBLE AS av, CASE WHEN p_size % 2 = 0 THEN 0.77 ELSE 0.44 END::DOUBLE AS ac, p_size % 5 = 0 AS changed,
      CASE WHEN p_size % 5 = 0 THEN [0.85, 0.68, 0.50][p_partkey % 3 + 1] ELSE [0.85, 0.62, 0.27][p_partkey % 3 + 1] END::DOUBLE AS pr, CASE WHEN p_size % 3 = 0 THEN 0.85 ELSE 0.62 END::DOUBLE AS ui,
      1 - (1 - [0.0, 0.22, 0.56][p_size % 3 + 1]::DOUBLE) * (1 - [0.56, 0.22, 0.0, 0.0, 0.0][p_partkey % 5 + 1]::DOUBLE) * (1 - 0.56::DOUBLE) AS iss FROM part),
    w AS (SELECT *, CASE WHEN changed THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS impact FROM v),
    s AS (SELECT *, round_even(least((impact + 8.22::DOUBLE * av * ac * pr * ui) * CASE WHEN changed THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END, 10.0) * 100000, 0)::BIGINT AS scaled FROM w),
    f AS (SELECT p_partkey, vector, CASE WHEN bad THEN NULL WHEN impact <= 0 THEN 0.0::DOUBLE WHEN scaled % 10000 = 0 THEN scaled / 100000.0::DOUBLE ELSE (scaled // 10000 + 1) / 10.0::DOUBLE END AS score FROM s)
    SELECT p_partkey, vector, score FROM f"""


@query(f"SELECT p_partkey, vector, round(score, 6) AS score, CASE WHEN score >= 7.0 THEN 'high' WHEN score >= 4.0 THEN 'med' ELSE 'low' END AS band FROM ({CVSS_SQL})")
def fn_cvss(spark, sf_dir):
    rows = spark.sql(f"SELECT p_partkey, {VECTOR} AS vector FROM {{part}}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    score = numbers.cvss_base(F.col("vector"))
    return rows.select("p_partkey", "vector", F.round(score, 6).alias("score"), numbers.cvss_band(score).alias("band"))


POINTS = [(0.0, 0.0), (100.0, 0.25), (1000.0, 0.5), (5000.0, 0.75), (9000.0, 0.9)]


def interpolation_sql(value: str, points: list[tuple[float, float]]) -> str:
    """The same steps as numbers.interpolate, in doubles throughout."""
    steps = " ".join(f"WHEN {value} <= {v1!r}e0 THEN {p0!r}e0 + ({value} - {v0!r}e0) / {v1 - v0!r}e0 * {p1 - p0!r}e0" for (v0, p0), (v1, p1) in zip(points, points[1:], strict=False))
    return f"CASE WHEN {value} <= {points[0][0]!r}e0 THEN {points[0][1]!r}e0 {steps} ELSE {points[-1][1]!r}e0 END"


@query(f"SELECT c_custkey, round({interpolation_sql('c_acctbal', POINTS)}, 9) AS percentile FROM customer")
def base_interp(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.round(numbers.interpolate(F.col("c_acctbal"), POINTS), 9).alias("percentile"))


@query("SELECT c_custkey, round(CASE WHEN hi = lo THEN 0.5 ELSE (c_acctbal - lo) / (hi - lo) END, 6) AS scaled FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def agg_minmax_norm(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    ends = rows.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return rows.crossJoin(F.broadcast(ends)).select("c_custkey", F.round(numbers.min_max(F.col("c_acctbal"), F.col("lo"), F.col("hi")), 6).alias("scaled"))
