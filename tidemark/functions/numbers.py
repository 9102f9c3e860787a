"""Normalisers, percentiles, breakpoints and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the published CVSS v3 base metrics.
CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20},
    "AC": {"L": 0.77, "H": 0.44},
    "PR_U": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_C": {"N": 0.85, "L": 0.68, "H": 0.50},
    "UI": {"N": 0.85, "R": 0.62},
    "CIA": {"N": 0.0, "L": 0.22, "H": 0.56},
}


def min_max(value: Column, lo: Column, hi: Column) -> Column:
    """Scaled to [0, 1]; 0.5 where there is no spread."""
    return F.when(hi == lo, 0.5).otherwise((value - lo) / (hi - lo))


def size_bucket(files: Column) -> Column:
    return F.when(files <= 20, "small").when(files <= 200, "medium").otherwise("large")


def severity(value: Column, high: float, med: float) -> Column:
    return F.when(value >= high, "high").when(value >= med, "med").otherwise("low")


def severity_weight(name: Column) -> Column:
    return F.when(name == "high", 3).when(name == "med", 2).otherwise(1)


def interpolate(value: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through (value, percentile) points, clamped at both ends."""
    out = F.when(value <= points[0][0], points[0][1])
    for (v0, p0), (v1, p1) in zip(points, points[1:], strict=False):
        if v1 > v0:
            out = out.when(value <= v1, p0 + (value - v0) / (v1 - v0) * (p1 - p0))
    return out.otherwise(points[-1][1])


def rank_index(n: Column, fraction: float, rule: str) -> Column:
    """0-based index of a percentile among n sorted values; the rules differ in rounding.

    floor: int(f(n-1)); corpus: half-even round(f(n-1)); ops: max(1, half-even round(f n)) - 1.
    """
    if rule == "floor":
        return F.floor(F.lit(fraction) * (n - 1)).cast("long")
    if rule == "corpus":
        return F.bround(F.lit(fraction).cast("double") * (n - 1), 0).cast("long")
    return F.greatest(F.bround(F.lit(fraction).cast("double") * n, 0).cast("long"), F.lit(1)) - 1


def activity_bucket(value: Column, most: Column) -> Column:
    return F.when(most <= 0, 0).otherwise(F.least(F.ceil(5 * F.sqrt(value / most)), F.lit(5))).cast("int")


def cvss_base(vector: Column) -> Column:
    """The base score of a CVSS v3 vector; null where a metric is missing or unknown."""
    m = F.str_to_map(vector, F.lit("/"), F.lit(":"))
    look = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in CVSS[table].items() for x in kv]), F.element_at(m, key))
    changed = F.element_at(m, "S") == "C"
    c, i, a = (look("CIA", k) for k in "CIA")
    iss = 1 - (1 - c) * (1 - i) * (1 - a)
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, 15)).otherwise(6.42 * iss)
    ease = 8.22 * look("AV", "AV") * look("AC", "AC") * F.when(changed, look("PR_C", "PR")).otherwise(look("PR_U", "PR")) * look("UI", "UI")
    total = F.least((impact + ease) * F.when(changed, 1.08).otherwise(1.0), F.lit(10.0))
    scaled = F.bround(total * 100000, 0).cast("long")
    up = F.when(scaled % 10000 == 0, scaled / 100000.0).otherwise((F.floor(scaled / 10000) + 1) / 10.0)
    return F.when(F.element_at(m, "S").isNotNull() & ease.isNotNull() & iss.isNotNull(), F.when(impact <= 0, 0.0).otherwise(up))


def cvss_band(score: Column) -> Column:
    return F.when(score >= 7.0, "high").when(score >= 4.0, "med").otherwise("low")
