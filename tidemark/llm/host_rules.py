"""Quality rules with host-level verdicts.

Each text is measured in one pass (words, symbols, repeated lines and windows) and fails or passes each
rule. Failures are counted by host; the rate of a host is shrunk towards all hosts by a beta prior whose
mean and strength come from the hosts themselves (method of moments); a host whose shrunk rate of any
rule is over the limit is rejected, and its verdict meets its documents again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import documents, meet_groups, stage

BLANK = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: What a document fails, by its measures.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
}
#: The rules whose failure drops a document by itself.
BASE = ("few_words", "repeats")


@dataclass(frozen=True)
class Hosts:
    """limit: a host's shrunk rate of one rule may not be above it. The prior counts as `weakest` to `strongest` documents."""

    limit: float = 0.5
    weakest: float = 1.0
    strongest: float = 10_000.0


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows of so many words that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    # Windows are numbered one word at a time, so that the numbers stay below n * n.
    ids = codes[: n - window + 1]
    for i in range(1, window):
        _, ids, counts = np.unique(ids * len(known) + codes[i : n - window + 1 + i], return_inverse=True, return_counts=True)
    again = counts[ids] > 1
    inside = np.zeros(n, bool)
    for i in range(window):
        inside[i : n - window + 1 + i] |= again
    return int(inside.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text has none. bytes.split knows the six blanks and no others."""
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    chars = len(text or "") - sum(map(data.count, map(str.encode, BLANK)))
    return len(words), chars, sum(map(data.count, map(str.encode, SYMBOLS))), len(lines) - len(set(lines)), repeated_words(words)


def measured(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measures(t) for t in text], columns=[c.split()[0] for c in MEASURES.split(", ")], dtype="int64")


def failure_rates(rows: DataFrame, rules: dict[str, str] = RULES, hosts: Hosts = Hosts()) -> DataFrame:
    """host, rule, n, failures, prior_mean, prior_weight, rate: rate is (failures + mean * weight) / (n + weight).

    rows: host and the measures. The prior of a rule: its mean is the share of failures in all documents;
    its weight is 1 / r - 1, where r is the variance between hosts (what is left of the weighted squares
    of differences beyond chance) over mean * (1 - mean), kept between weakest and strongest.
    """
    sums = rows.groupBy("host").agg(F.count("*").alias("n"), *[F.count(F.when(F.expr(test), 1)).alias(rule) for rule, test in rules.items()])
    long = sums.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failures")) for r in rules])).alias("x")).select("host", "x.rule", "n", "x.failures")
    n, k = F.col("n").cast("double"), F.col("failures").cast("double")
    whole = long.groupBy("rule").agg(F.count("*").cast("double").alias("h"), F.sum(n).alias("big_n"), F.sum(k).alias("big_k"), F.sum(k * k / n).alias("q"), F.sum(n * n).alias("nn"))
    mean = F.col("big_k") / F.col("big_n")
    chance = mean * (1 - mean)
    free = F.col("big_n") - F.col("nn") / F.col("big_n")
    between = F.when(free > 0, (F.col("q") - F.col("big_n") * mean * mean - (F.col("h") - 1) * chance) / free)
    weight = F.when((between > 0) & (chance > 0), F.greatest(F.least(chance / between - 1, F.lit(hosts.strongest)), F.lit(hosts.weakest))).otherwise(F.lit(hosts.strongest))
    # One row a rule.
    prior = whole.select("rule", mean.alias("prior_mean"), weight.alias("prior_weight"))
    found = long.join(F.broadcast(prior), "rule")
    return found.withColumn("rate", (F.col("failures") + F.col("prior_mean") * F.col("prior_weight")) / (F.col("n") + F.col("prior_weight")))


def host_verdicts(rows: DataFrame, rules: dict[str, str] = RULES, hosts: Hosts = Hosts()) -> DataFrame:
    """host, n, host_rejected: one row a host."""
    return failure_rates(rows, rules, hosts).groupBy("host").agg(F.max("n").alias("n"), (F.max("rate") > hosts.limit).alias("host_rejected"))


def judge(docs: DataFrame, hosts: Hosts = Hosts(), id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """row_id, host, the measures, base_failed, host_rejected, kept: one row for every row of docs.

    host: by default the column source. Null hosts are one host named by the empty string; null texts
    have no words and fail; null ids and repeated rows are documents of their own; texts of any length
    are measured whole; an empty input gives an empty result; other columns are ignored. A document stays
    if it fails no base rule and its host is not rejected.
    """
    named = F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit(""))
    seen = docs.select(F.col(id_col).alias("row_id"), named.alias("host"), pandas_udf(measured, MEASURES)(F.col(text_col)).alias("m")).select("row_id", "host", "m.*")
    rows = stage(seen.withColumn("base_failed", F.expr(" or ".join(f"({RULES[r]})" for r in BASE))), "measures")
    verdicts = stage(host_verdicts(rows, RULES, hosts), "host-verdicts")
    found = meet_groups(rows, verdicts, "host", "n")
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("n")


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(documents(spark, sf_dir))
    return found.select(F.col("row_id").alias("doc_id"), *[c.split()[0] for c in MEASURES.split(", ")], "base_failed", "kept")


QUERIES = {"op12_host_rules": op12_host_rules}

ORACLE_SQL = {
    "op12_host_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
        split AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
        each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split),
        windows AS (
            SELECT doc_id, i, word AS w1, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS w2, lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w3 FROM each
        ),
        again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) > 1 AS twice FROM windows WHERE w3 IS NOT NULL),
        inside AS (SELECT DISTINCT doc_id, i + k AS i FROM again, (VALUES (0), (1), (2)) AS s(k) WHERE twice),
        repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM inside GROUP BY doc_id),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        m AS (
            SELECT split.doc_id, host, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM split LEFT JOIN dups ON split.doc_id = dups.doc_id LEFT JOIN repeats ON split.doc_id = repeats.doc_id
        ),
        f AS (SELECT *, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repeats, 10 * n_symbols > n_words AS symbols FROM m),
        long AS (
            SELECT host, 'few_words' AS rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE few_words) AS DOUBLE) AS k FROM f GROUP BY host
            UNION ALL SELECT host, 'repeats', count(*), count(*) FILTER (WHERE repeats) FROM f GROUP BY host
            UNION ALL SELECT host, 'symbols', count(*), count(*) FILTER (WHERE symbols) FROM f GROUP BY host
        ),
        sums AS (SELECT rule, count(*) AS h, sum(n) AS nn, sum(k) / sum(n) AS mean, sum(k * k / n) AS q, sum(n) - sum(n * n) / sum(n) AS free FROM long GROUP BY rule),
        spread AS (SELECT rule, mean, mean * (1 - mean) AS chance, CASE WHEN free > 0 THEN (q - nn * mean * mean - (h - 1) * mean * (1 - mean)) / free END AS between_hosts FROM sums),
        prior AS (
            SELECT rule, mean, CASE WHEN between_hosts > 0 AND chance > 0 THEN greatest(least(chance / between_hosts - 1, 10000.0), 1.0) ELSE 10000.0 END AS weight FROM spread
        ),
        verdicts AS (SELECT host, max((k + mean * weight) / (n + weight)) > 0.5 AS rejected FROM long JOIN prior USING (rule) GROUP BY host)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed, NOT (few_words OR repeats) AND NOT rejected AS kept
        FROM f JOIN verdicts USING (host)
    """
}
