"""Grounding of generated sentences: every number and every name in them must come from the facts they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The longest text, endings of files, and the steps that figures are rounded to.
LONGEST = 600
ENDINGS = [
    "py", "js", "jsx", "ts", "tsx", "mjs", "cjs", "java", "json", "toml", "yml", "yaml", "md", "txt", "lock", "xml", "gradle", "kts", "cfg", "ini", "env",
]
STEPS = [5, 10, 25, 50, 100, 1000, 10000]
#: Figures as they are written: groups of three, a fraction, a percent sign.
NUMBER = r"(?<![\w.])\d{1,3}(?:,\d{3})*(?:\.\d+)?%?(?!\w)"
#: File names, paths, snake_case and camelCase.
NAMES = [
    r"(?i)\b\w[\w.\-]*\.(?:" + "|".join(ENDINGS) + r")\b",
    r"\b[\w.\-]+/[\w./\-]+\b",
    r"\b[a-zA-Z][a-zA-Z0-9]*_[a-zA-Z0-9_]*[a-zA-Z0-9]\b",
    r"\b[a-zA-Z]*[a-z][A-Z][a-zA-Z0-9]*\b",
]
#: What is wrong with a text, the first that holds.
REASONS = ["too_long", "looks_truncated", "ungrounded_number", "ungrounded_reference"]


def two_digits(value: Column) -> Column:
    """A number to two significant digits."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 1)
    return F.when(value == 0, 0.0).otherwise(F.rint(value / power) * power)


def roundings(value: Column) -> Column:
    """The figures that a writer may give for a number: itself, two digits, whole, and the nearest of steps up to ten times its size."""
    near = [F.when(F.lit(float(s)) <= F.greatest(F.abs(value), F.lit(1.0)) * 10, F.rint(value / s) * s) for s in STEPS]
    return F.filter(F.array(value, two_digits(value), F.rint(value), *near), lambda x: x.isNotNull())


def accepted_numbers(facts: DataFrame) -> DataFrame:
    """(subject, figure): all figures that the numbers of a subject allow; a share from 0 to 1 may be given in percent too."""
    value = F.col("value")
    every = F.concat(roundings(value), F.when(value.between(0, 1), roundings(value * 100)).otherwise(F.array().cast("array<double>")))
    return facts.where("value is not null").select("subject", F.explode(every).alias("figure")).select("subject", F.round("figure", 6).alias("figure")).distinct()


def written_numbers(texts: DataFrame) -> DataFrame:
    """(text_id, subject, figure) of the numbers in texts."""
    found = texts.select("text_id", "subject", F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("raw"))
    return found.select("text_id", "subject", F.round(F.regexp_replace("raw", "[,%]", "").cast("double"), 6).alias("figure"))


def written_names(texts: DataFrame) -> DataFrame:
    """(text_id, subject, name) of what looks like a file, a path or an identifier, in lower case."""
    every = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in NAMES])
    found = texts.select("text_id", "subject", F.explode(F.array_distinct(every)).alias("raw"))
    return found.select("text_id", "subject", F.lower(F.regexp_replace("raw", r"^[.,;:()]+|[.,;:()]+$", "")).alias("name"))


def validated(texts: DataFrame, facts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(text_id, ok, reason): whether a text may be shown.

    texts: text_id, subject, text; facts: subject, name, value (double), words (string); vocabulary: name, what
    every text may say. A text must not be over LONGEST code points, must end as a sentence does, and
    all its numbers and names must be its subject's: they are anti-joined with the figures and words of
    that subject. The reason names the first check that failed; null texts look truncated.
    """
    text = F.coalesce("text", F.lit(""))
    ends = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+$", "")), r"[\"')]+$", "").rlike(r"[.!?]$")
    rows = texts.select("text_id", F.when(F.char_length(text) > LONGEST, REASONS[0]).when(~ends, REASONS[1]).alias("form"))
    # What is exploded from texts and facts is larger than Spark estimates, so that no side of it may be broadcast.
    # Figures of a subject are few and distinct, so a subject that many texts share is no pair explosion.
    odd_numbers = written_numbers(texts).join(accepted_numbers(facts).hint("merge"), ["subject", "figure"], "left_anti").select("text_id").distinct().withColumn("odd_number", F.lit(True))
    known = facts.select("subject", F.explode(F.array("name", "words")).alias("name")).where("name is not null").select("subject", F.lower("name").alias("name")).distinct()
    odd_names = written_names(texts).join(known.hint("merge"), ["subject", "name"], "left_anti").join(vocabulary.select(F.lower("name").alias("name")).distinct(), "name", "left_anti")
    odd_names = odd_names.select("text_id").distinct().withColumn("odd_name", F.lit(True))
    rows = rows.join(odd_numbers.hint("merge"), "text_id", "left").join(odd_names.hint("merge"), "text_id", "left")
    reason = F.coalesce("form", F.when(F.col("odd_number"), REASONS[2]).when(F.col("odd_name"), REASONS[3]))
    return rows.select("text_id", reason.isNull().alias("ok"), reason.alias("reason"))
