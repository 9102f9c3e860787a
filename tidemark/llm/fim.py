"""Fill-in-the-middle: relational units.

A text is a sequence of units, the matches of an expression from left to right. Two ordinals of units
cut it into prefix, middle and suffix. The offsets of the cuts come from relations: matches are
exploded with their positions, a window sums up the units' lengths, the cut requests meet the units by
ordinal, and the offsets of a document are aggregated; then the text is cut by substring.

Units are exploded at two levels, so that not every character becomes a row: first runs of RUN units,
whose lengths are summed up over the text, then the units of the runs in which a cut lies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

#: One code point, line breaks included.
CODE_POINT = "(?s:.)"
#: Units in a run.
RUN = 64
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text together with its id.
KEY = ["k1", "k2"]


@dataclass(frozen=True)
class Fim:
    """unit: an expression; what it leaves out is cut into code points. Rates are in hundredths."""

    unit: str = CODE_POINT
    cut_rate: int = 90
    spm_rate: int = 20


def tiles(unit: str) -> str:
    """An expression whose matches leave no gap: the unit, else one code point."""
    return CODE_POINT if unit == CODE_POINT else f"(?:{unit}|{CODE_POINT})"


def count_units(text: Column, unit: str) -> Column:
    return (F.char_length(text) if unit == CODE_POINT else F.regexp_count(text, F.lit(tiles(unit)))).cast("long")


def draws(row_id: Column) -> list[Column]:
    """h1 to h4: eight hex digits each of the SHA-256 of `1:` and the decimal id (null: nothing after the colon)."""
    hexed = F.sha2(F.concat(F.lit("1:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]


def choose(docs: DataFrame, fim: Fim, id_col: str, text_col: str) -> DataFrame:
    """row_id, text, its key, n, form, and the units before each cut: first and second (null where plain)."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("row_id", "text").alias("k1"), F.xxhash64(F.lit("fim"), "row_id", "text").alias("k2"), count_units(F.col("text"), fim.unit).alias("n"))
    h1, h2, h3, h4 = draws(F.col("row_id"))
    marked = F.greatest(*[F.locate(m, F.col("text")) for m in (PREFIX, SUFFIX, MIDDLE)]) > 0
    plain = (F.col("text") == "") | marked | (h3 % 100 >= fim.cut_rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < fim.spm_rate, "spm").otherwise("psm"))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    return rows.withColumn("first", F.when(F.col("form") != "plain", F.least(a, b))).withColumn("second", F.when(F.col("form") != "plain", F.greatest(a, b)))


def offsets(rows: DataFrame, unit: str = CODE_POINT, run: int = RUN) -> DataFrame:
    """k1, k2, first_at, second_at: the code points before each cut, one row a key with a cut after its first unit.

    Only the texts of runs with a cut travel; of the others their lengths do, as one array a text.
    Repeated rows become one before they are shuffled.
    """
    tile = tiles(unit)
    cut = rows.where("second > 0")
    in_run = lambda c: F.floor((F.col(c) - 1) / run).cast("int")
    parts = F.slice(F.regexp_extract_all("text", F.lit(f"{tile}{{1,{run}}}+"), F.lit(0)), F.lit(1), in_run("second") + 1)
    sizes = F.transform("parts", lambda x: F.struct(count_units(x, unit).cast("int").alias("units"), F.char_length(x).alias("chars")))
    held = F.struct(sizes.alias("sizes"), F.when(F.col("first") > 0, in_run("first")).alias("a"), F.get("parts", in_run("first")).alias("a_part"), in_run("second").alias("b"), F.get("parts", in_run("second")).alias("b_part"))
    once = cut.withColumn("parts", parts).groupBy(*KEY).agg(F.max(held).alias("x"))
    runs = once.select(*KEY, "x.a", "x.a_part", "x.b", "x.b_part", F.posexplode("x.sizes").alias("run_no", "size"))
    part = F.when(F.col("run_no") == F.col("b"), F.col("b_part")).when(F.col("run_no") == F.col("a"), F.col("a_part"))
    runs = runs.select(*KEY, "run_no", part.alias("part"), "size.units", "size.chars")
    earlier = Window.partitionBy(*KEY).orderBy("run_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = runs.select(
        *KEY, "part", "units", (F.sum("units").over(earlier) - F.col("units")).alias("units_before"), (F.sum("chars").over(earlier) - F.col("chars")).alias("chars_before")
    ).where("part is not null")
    requests = cut.select(*KEY, F.posexplode(F.array("first", "second")).alias("cut_no", "ordinal")).where("ordinal > 0").distinct()
    met = summed.join(requests, KEY).where("ordinal > units_before and ordinal <= units_before + units")
    each = met.select(*KEY, "cut_no", "ordinal", "chars_before", "units_before", F.posexplode(F.regexp_extract_all("part", F.lit(tile), F.lit(0))).alias("unit_no", "unit"))
    within = Window.partitionBy(*KEY, "cut_no").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("at", F.col("chars_before") + F.sum(F.char_length("unit")).over(within)).where("units_before + unit_no + 1 = ordinal")
    return placed.groupBy(*KEY).agg(F.max(F.when(F.col("cut_no") == 0, F.col("at"))).alias("first_at"), F.max(F.when(F.col("cut_no") == 1, F.col("at"))).alias("second_at"))


def fill_in_middle(docs: DataFrame, fim: Fim = Fim(), id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """row_id, n, form, prefix_chars, middle_chars, output: one row for every row of docs.

    n counts units. form: plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix,
    middle), each part behind its mark. A text is plain if it is empty or null, if it contains a mark, or
    by its draw; its prefix_chars and middle_chars are null. Draws depend on the id alone, so rows that
    repeat id and text give equal results; null ids share one draw. Texts of any length are cut whole;
    an empty input gives an empty result; other columns are ignored.
    """
    rows = choose(docs, fim, id_col, text_col)
    plain = F.col("form") == "plain"
    # Only texts with cuts are shuffled.
    both = rows.where(~plain).join(offsets(rows, fim.unit, run), KEY, "left")
    first, second = (F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("first_at", "second_at"))
    none = F.lit(None).cast("int")
    both = both.select("row_id", "n", "form", "text", first.alias("a"), second.alias("b")).unionByName(rows.where(plain).select("row_id", "n", "form", "text", none.alias("a"), none.alias("b")))
    text = F.col("text")
    prefix, middle, suffix = F.substring(text, F.lit(1), F.col("a")), F.substring(text, F.col("a") + 1, F.col("b") - F.col("a")), F.substring(text, F.col("b") + 1, F.char_length(text))
    output = (
        F.when(plain, text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return both.select("row_id", "n", "form", F.col("a").cast("long").alias("prefix_chars"), (F.col("b") - F.col("a")).cast("long").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that gave this output. A text with a mark in it stays plain, and no mark can arise where parts meet."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op11_relational_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(documents(spark, sf_dir))
    return found.select(
        F.col("row_id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {"op11_relational_fim": op11_relational_fim}

ORACLE_SQL = {
    "op11_relational_fim": r"""
        WITH hashed AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), drawn AS (
            SELECT doc_id, text, n,
                   CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
                   CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS z, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS w
            FROM hashed
        ), formed AS (
            SELECT doc_id, text, n, least(x, y) AS a, greatest(x, y) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR z >= 90 THEN 'plain' WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ), parted AS (
            SELECT doc_id, text, n, form, a, b, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM formed
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parted
    """
}
