"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived (any of several sets, all
of whose trigrams a text must hold for the rule to match). The index keeps, for the trigrams that
the rules ask for, the texts that hold them; postings are intersected in Spark, and only the texts
found are verified against a rule's expression. Rules without a mandatory trigram scan every text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, stage


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if this group (0: the whole match) has at least so many characters.
    group: int = 0
    least: int = 0


# The three base rules, as the contract words them.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Formats of well-known credentials.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("live_key", r"\b[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("map_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"(?ai:authorization: bearer )[A-Za-z0-9._~+/-]{16,}"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{2,12}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE + ADDED

# --- Boolean trigram queries -------------------------------------------------------------------

#: A query is a set of clauses, any of which will do; a clause is a set of trigrams, all needed.
Query = frozenset
ANY: Query = frozenset([frozenset()])


def _all(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b))


def _least(q: Query) -> Query:
    """Drop clauses that another one implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _of(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(items, most: int = 64) -> tuple[set[str] | None, Query]:
    """(the exact lower-case strings it matches, or None; what any match must hold)."""
    exact, query, lost = {""}, ANY, False
    for op, arg in items:
        own, needs = _one(op, arg)
        if own is not None and len(exact) * len(own) <= most:
            exact = {a + b for a in exact for b in own}
            continue
        query, lost = _all(query, _of(exact)), True
        if own is not None and len(own) <= most:
            exact = own
        else:
            query, exact = _all(query, needs), {""}
    return (None, _all(query, _of(exact))) if lost else (exact, _of(exact))


def _one(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is C.AT:
        return {""}, ANY
    if op is C.IN and len(arg) <= 8 and all(k is C.LITERAL for k, _ in arg):
        return {chr(v).lower() for _, v in arg}, ANY
    if op is C.SUBPATTERN:
        return _walk(arg[-1])
    if op is C.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(e is not None for e, _ in parts):
            return set().union(*(e for e, _ in parts)), ANY
        return None, _least(frozenset().union(*(q for _, q in parts)))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        lo, hi, sub = arg
        own, needs = _walk(sub)
        if own is not None and hi == 1:
            return own | {""} if lo == 0 else own, ANY
        if own is not None and lo == hi and lo <= 4 and len(own) ** lo <= 64:
            return _walk(list(sub) * lo)
        return None, ANY if lo == 0 else (_of(own) if own is not None else needs)
    return None, ANY


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text must hold for the pattern to match in it; ANY where nothing is mandatory."""
    exact, query = _walk(P.parse(pattern))
    return _of(exact) if exact is not None else query


# --- the scan ----------------------------------------------------------------------------------


def spans_of(text: str, rules, wanted: set[str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the matches of the wanted rules: leftmost, not overlapping within a kind."""
    order = {r.kind: i for i, r in enumerate(rules)}
    found = []
    for r in rules:
        if r.kind in wanted:
            for m in re.finditer(r.pattern, text):
                if m.end(r.group) - m.start(r.group) >= r.least:
                    found.append((m.start(), m.end(), r.kind))
    return sorted(found, key=lambda x: (x[0], order[x[2]]))


def build_index(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """The postings (trigram, key), sorted by trigram within each file: key is the text's hash, so copies share one."""
    texts = docs.select(F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where("text is not null")

    def post(batches):
        for pdf in batches:
            seen: list[tuple[str, int]] = []
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                low = text.lower()
                seen += [(t, key) for t in trigrams if t in low]
            yield pd.DataFrame(seen, columns=["trigram", "key"])

    return stage(texts.mapInPandas(post, "trigram string, key long").sortWithinPartitions("trigram"), "trigram-postings")


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the texts that satisfy each rule's query."""
    wanted = [(kind, i, len(c), t) for kind, q in queries.items() for i, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    # As many rows as the rules have trigrams, whatever the corpus holds.
    asked = postings.sparkSession.createDataFrame(wanted, "kind string, clause int, needs int, trigram string")
    met = postings.join(F.broadcast(asked), "trigram").groupBy("key", "kind", "clause", "needs").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = needs").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, rules=RULES, text_col: str = "text", name: str = "found") -> DataFrame:
    """docs with an array of (kind, start, stop) in code points, by start and then in the rules' order.

    Null texts count as empty and have no spans; whole texts are searched, whatever their length;
    repeated rows and equal texts share a posting and are each reported; an empty input gives an
    empty result; all columns are kept, but for one that bears the result's name.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    always = {k for k, q in queries.items() if q == ANY}
    indexed = {k: q for k, q in queries.items() if k not in always}
    trigrams = sorted({t for q in indexed.values() for c in q for t in c})
    found = stage(candidates(build_index(docs, trigrams, text_col), indexed), "secret-candidates")
    key, kinds = fresh(docs, "key", "kinds")
    found = found.select(F.col("key").alias(key), F.col("kinds").alias(kinds))

    @F.pandas_udf("array<struct<kind:string,start:int,stop:int>>")
    def verify(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, kinds, strict=True):
            wanted = always if own is None else always.union(own)
            out.append([] if not text else [{"kind": k, "start": a, "stop": b} for a, b, k in spans_of(text, rules, wanted)])
        return pd.Series(out, dtype=object)

    # Null texts have no posting; they are spread by their other columns, so that they share no task.
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumn(key, F.when(F.col(text_col).isNull(), F.xxhash64(*plain)).otherwise(F.xxhash64(F.col(text_col))))
    joined = keyed.join(found.hint("shuffle_hash"), key, "left")
    return joined.withColumn(name, verify(F.col(text_col), F.col(kinds))).select(*[c for c in docs.columns if c != name], name)


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = [r.kind for r in BASE]
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of_kind = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[of_kind(k) for k in base], F.sha2(text_of(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), text_of(F.col("found")).alias("spans"))


QUERIES = {"op4_trigram_secrets": op4_trigram_secrets}
