"""Requirement files and what they include: the closure of -r and -c over a tree."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import folder, normal
from tidemark.operators.tables import saved

INCLUDE = re.compile(r"^(-r|--requirement|-c|--constraint)[\s=]+(\S+)")
NAMED = re.compile(r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:==\s*([^\s;#,]+))?")


def lines_of(path: str, text: str) -> list[tuple[int, str, str, str | None]]:
    """(line, kind, name, version) of a requirement file: kind is package, requirement or constraint; other flags and URLs are left out."""
    out = []
    for no, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        if m := INCLUDE.match(line):
            out.append((no, "requirement" if m[1] in ("-r", "--requirement") else "constraint", m[2], None))
        elif not line.startswith("-") and "://" not in line and (m := NAMED.match(line)):
            out.append((no, "package", m[1].lower(), m[2]))
    return out


def closure(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """(manifest, file, constrains): every file that a root includes, itself too, each once, however the references run.

    lines: path, kind, name. A reference is relative to the folder of the file it is in. A file that is
    reached as a requirement anywhere counts as one; what is reached through constraints alone only
    constrains. Rounds follow the longest chain of references; a cycle ends where it meets itself.
    """
    refs = lines.where("kind <> 'package'").select(F.col("path").alias("file"), normal(F.concat_ws("/", folder(F.col("path")), "name")).alias("to"), (F.col("kind") == "constraint").alias("c")).distinct()
    front = saved(roots.select(F.col("path").alias("manifest"), F.col("path").alias("file"), F.lit(False).alias("constrains")))
    seen = front
    while True:
        nxt = front.join(refs, "file").select("manifest", F.col("to").alias("file"), (F.col("constrains") | F.col("c")).alias("constrains")).distinct()
        front = saved(nxt.join(seen, ["manifest", "file", "constrains"], "left_anti"))
        if front.isEmpty():
            break
        seen = saved(seen.unionByName(front))
    return seen.groupBy("manifest", "file").agg(F.min("constrains").alias("constrains"))


def required(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, package, version, declared_in) of every package that a root requires; path is the root.

    Files that are not in the tree include nothing. Where a requirement has no version of its own, a
    constraint's pin for that package stands; a package that is only constrained is not required.
    """
    own = closure(lines, roots).join(lines.where("kind = 'package'").select(F.col("path").alias("file"), F.col("name").alias("package"), "version"), "file")
    needs = own.where("not constrains").groupBy("manifest", "package", "file").agg(F.max("version").alias("version"))
    pins = own.where("constrains and version is not null").groupBy("manifest", "package").agg(F.max("version").alias("pin"))
    return needs.join(pins, ["manifest", "package"], "left").select(F.col("manifest").alias("path"), "package", F.coalesce("version", "pin").alias("version"), F.col("file").alias("declared_in"))
