"""Fill-in-the-middle, host rules, filter audit: against SQL, brute force and hand-made hosts."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SF, edge_docs, empty_docs, repeated
from tidemark import llm
from tidemark.llm import filter_audit, fim, host_rules


@pytest.mark.parametrize("name", ["op11_relational_fim", "op12_host_rules", "op13_subset_zeta_audit"])
def test_rows_are_those_of_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = llm.queries()[name](spark, SF)
    assert df.columns == columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def units_of(text, unit):
    return re.findall(unit if unit == "." else f"{unit}|.", text, re.S)


def brute_fim(row_id, text, unit=".", cut_rate=90, spm_rate=20):
    text = text or ""
    own = units_of(text, unit)
    n, hexed = len(own), hashlib.sha256(f"1:{'' if row_id is None else row_id}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut_rate:
        return row_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (own[:a], own[a:b], own[b:]))
    if h[3] % 100 < spm_rate:
        return row_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return row_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


MARKED = ["has <P> inside", "<S>", "ends in <M>", "<P", "almost <P <S M> <<", "<P<S<M" * 30]


@pytest.mark.parametrize("unit,run", [(".", 64), (".", 1), (".", 3), ("[0-9A-Za-z]+", 5), (r"\n|[^\n]+\n?", 2)])
def test_cuts_are_those_of_brute_force(spark, unit, run):
    docs = repeated(spark).select("doc_id", "text", "source")
    more = [(1000 + i, t, "x") for i, t in enumerate(MARKED * 20)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = fim.fill_in_middle(docs, fim.Fim(unit=fim.CODE_POINT if unit == "." else unit), run=run).collect()
    want = [brute_fim(r.doc_id, r.text, unit) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_every_cut_gives_its_text_back(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(MARKED * 50)], "doc_id long, text string")
    made = fim.fill_in_middle(docs, fim.Fim(cut_rate=100)).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    assert made.join(docs, made.row_id == docs.doc_id).where("back <> text").count() == 0
    assert made.where("form <> 'plain'").count() == 3 * 50


def test_many_equal_rows_are_cut_alike(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text of many rows " * 9).alias("text"))
    got = fim.fill_in_middle(docs).groupBy("n", "form", "prefix_chars", "middle_chars", "output").count().collect()
    assert [r["count"] for r in got] == [3000] and tuple(got[0])[:5] == brute_fim(None, "the same text of many rows " * 9)[1:]


def test_fim_of_no_rows(spark):
    assert fim.fill_in_middle(empty_docs(spark)).count() == 0


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_measures_of_edge_cases(spark):
    docs = repeated(spark)
    got = host_rules.judge(docs)
    want = [(r.doc_id, r.source or "", *brute_measures(r.text)) for r in docs.collect()]
    assert sorted(map(repr, (tuple(r)[:7] for r in got.collect()))) == sorted(map(repr, want))
    assert host_rules.judge(empty_docs(spark)).count() == 0


def test_measures_of_few_kinds_of_words():
    r = random.Random(5)
    for n in range(120):
        text = "".join(r.choice(["a", "b", "c#", "数"]) + r.choice([" ", "\n", "\t ", "\x0b", " \x85 ", " \xa0"]) for _ in range(n))
        assert host_rules.measures(text) == brute_measures(text)


def rows_of_hosts(spark, hosts):
    """(host, documents, of these with few words)."""
    return spark.createDataFrame([(h, 10 if i < bad else 100, 0, 0) for h, n, bad in hosts for i in range(n)], "host string, n_words long, n_repeat_words long, n_symbols long")


HOSTS = [("junk", 200, 180), ("fine", 3000, 90), ("mixed", 100, 40), ("tiny", 1, 1), ("small", 4, 3), *((f"h{i}", 50, i % 4) for i in range(20))]


def test_rates_are_shrunk_by_the_prior_of_all_hosts(spark):
    got = {r.host: r for r in host_rules.failure_rates(rows_of_hosts(spark, HOSTS)).where("rule = 'few_words'").collect()}
    n, k = sum(h[1] for h in HOSTS), sum(h[2] for h in HOSTS)
    mean = k / n
    q = sum(b * b / a for _, a, b in HOSTS)
    between = (q - n * mean**2 - (len(HOSTS) - 1) * mean * (1 - mean)) / (n - sum(a * a for _, a, _ in HOSTS) / n)
    weight = max(1.0, min(10_000.0, mean * (1 - mean) / between - 1))
    for h, a, b in HOSTS:
        assert got[h].rate == pytest.approx((b + mean * weight) / (a + weight), rel=1e-9)
    # One failure of one document says less than 180 of 200.
    assert got["tiny"].rate < 0.6 < got["junk"].rate


def test_verdicts_of_hosts_meet_their_documents(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "too short"
    docs = [(i, good if i % 10 == 0 else bad, "junk") for i in range(300)] + [(1000 + i, bad if i % 20 == 0 else good, f"s{i % 7}") for i in range(700)]
    docs += [(5000, good, None), (None, good, "s1"), (None, good, "s1")]
    got = host_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {r.host for r in got if r.host_rejected} == {"junk"} and len(got) == len(docs)
    assert all(r.kept == (not r.base_failed and r.host != "junk") for r in got)
    assert sum(r.host == "junk" and not r.base_failed for r in got) == 30


def test_clean_documents_stay(spark):
    got = llm.queries()["op12_host_rules"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.kept != r.base_failed for r in got)


def brute_audit(rows, filters, labels):
    """rows: (part, mask, label...). Each order is applied row by row."""
    out, parts = {}, sorted({r[0] for r in rows})
    for part, order in itertools.product(parts, map("".join, itertools.permutations(filters))):
        own, left = [r for r in rows if r[0] == part], None
        left = list(own)
        for step, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            gone = [r for r in left if r[1] & bit]
            left = [r for r in left if not r[1] & bit]
            fails = [r for r in own if r[1] & bit]
            out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == bit for r in own), *(sum(bool(r[2 + i]) for r in gone) for i in range(labels))]
    for (part, order, step), v in list(out.items()):
        f = order[step - 1]
        out[part, order, step] = (*v, sum(out[p, o, s][1] for p, o, s in out if p == part and o[s - 1] == f))
    return out


@pytest.mark.parametrize("filters,labels", [("AB", ["good"]), ("WXYZ", ["good", "toxic"]), ("Q", [])])
def test_audit_is_that_of_every_order_walked(spark, filters, labels):
    r = random.Random(len(filters))
    rows = [(r.choice(["a", "b", ""]), r.randrange(1 << len(filters)), *(r.random() < 0.3 for _ in labels)) for _ in range(400)] + [("all pass", 0, *(True for _ in labels))]
    df = spark.createDataFrame(rows, ", ".join(["part string", "mask int", *(f"{x} boolean" for x in labels)]))
    got = filter_audit.interactions(df, filters, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in labels], "shapley").collect()
    want = brute_audit(rows, filters, len(labels))
    assert {tuple(x)[:3]: tuple(x)[3:] for x in got} == want and len(got) == len(want)


def test_masks_of_edge_cases(spark):
    docs = repeated(spark)
    rows = docs.collect()
    want = []
    for r in rows:
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t))]
        fails.append(r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == t for o in rows))
        want.append((r.doc_id, r.source or "", sum(1 << i for i, f in enumerate(fails) if f)))
    assert sorted(map(repr, map(tuple, filter_audit.mark(docs).collect()))) == sorted(map(repr, want))
    assert filter_audit.mark(empty_docs(spark)).count() == 0


def test_labels_of_ids_labelled_twice_or_never(spark):
    rows = spark.createDataFrame([(1, "p", 0), (1, "p", 1), (2, "p", 0), (None, "p", 0), (3, "p", 0)], "row_id long, part string, mask int")
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.with_labels(rows, labels).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "p", 0, True, True), (1, "p", 1, True, True), (2, "p", 0, False, False), (None, "p", 0, False, False), (3, "p", 0, False, False)]))


def test_audit_of_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(filter_audit.with_labels(filter_audit.mark(empty_docs(spark)), labels), "ABCDE", ["good", "toxic"]).count() == 0
