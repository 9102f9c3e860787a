"""Path aliases of script imports: each file takes those of the nearest configuration above it."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import ancestors, folder, normal
from tidemark.operators.tables import saved

#: Of two in one folder, the first counts.
CONFIG_NAMES = ["tsconfig.json", "jsconfig.json"]
#: A string, which stays, or a comment, which goes.
STRING_OR_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\r\n]*|/\*.*?\*/', re.S)


def plain_json(text: str) -> str:
    """JSON with comments and trailing commas as JSON."""
    bare = STRING_OR_COMMENT.sub(lambda m: m[1] or "", text)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)


def config_of(path: str, text: str) -> tuple[str | None, str | None, str | None]:
    """(the file that it extends, its base folder, its path patterns as JSON); all null where it does not parse."""
    try:
        data = json.loads(plain_json(text))
        options = data.get("compilerOptions", {})
        up, base, found = data.get("extends"), options.get("baseUrl"), options.get("paths")
    except (ValueError, AttributeError, RecursionError):
        return None, None, None
    here = posixpath.dirname(path)
    at = lambda x: posixpath.normpath(posixpath.join("/", here, x)).lstrip("/")
    # A name without a leading dot is a package, which no tree holds.
    up = (at(up) if up.endswith(".json") else at(up) + ".json") if isinstance(up, str) and up.startswith(".") else None
    found = {k: [x for x in v if isinstance(x, str)] for k, v in found.items() if isinstance(v, list) and v} if isinstance(found, dict) else None
    return up, at(base) if isinstance(base, str) else None, json.dumps(found) if found else None


def configurations(raw: DataFrame) -> DataFrame:
    """(folder, base, paths) of each folder whose configuration has patterns, by itself or from one that it extends.

    raw: path, extends, base, paths. What a configuration lacks comes from the next one along its chain
    that has it; patterns without a base folder start at the folder of the file that holds them. A
    chain that comes back to a file ends there.
    """
    own = raw.withColumn("home", F.when(F.col("paths").isNotNull(), folder(F.col("path")))).withColumn("seen", F.array("path"))
    up = raw.select(F.col("path").alias("extends"), F.col("extends").alias("next"), F.col("base").alias("up_base"), F.col("paths").alias("up_paths"))
    while not (own := saved(own)).where("extends is not null").isEmpty():
        met = own.join(up, "extends", "left")
        own = met.select(
            "path",
            F.when(~F.array_contains("seen", F.col("next")), F.col("next")).alias("extends"),
            F.coalesce("base", "up_base").alias("base"),
            F.coalesce("home", F.when(F.col("up_paths").isNotNull(), folder(F.col("extends")))).alias("home"),
            F.coalesce("paths", "up_paths").alias("paths"),
            F.when(F.col("extends").isNull(), F.col("seen")).otherwise(F.concat("seen", F.array("extends"))).alias("seen"),
        )
    name = F.element_at(F.split("path", "/"), -1)
    first = own.where(name.isin(CONFIG_NAMES)).groupBy(folder(F.col("path")).alias("folder"))
    first = first.agg(F.max_by(F.struct(F.coalesce("base", "home").alias("base"), "paths"), name).alias("x"))
    return first.select("folder", "x.*").where("paths is not null")


def patterns(configs: DataFrame) -> DataFrame:
    """(folder, base, rank, starred, before, after, target): one row for each replacement of a pattern, in the order written."""
    each = configs.select("folder", "base", F.posexplode(F.from_json("paths", "map<string, array<string>>")).alias("no", "pattern", "targets"))
    each = each.select("folder", "base", "no", "pattern", F.posexplode("targets").alias("sub", "target"))
    star = F.instr("pattern", "*")
    return each.select(
        "folder",
        "base",
        (F.col("no") * 1000 + F.col("sub")).alias("rank"),
        (star > 0).alias("starred"),
        F.when(star > 0, F.substring_index("pattern", "*", 1)).otherwise(F.col("pattern")).alias("before"),
        F.when(star > 0, F.substring(F.col("pattern"), star + 1, F.length("pattern"))).otherwise("").alias("after"),
        "target",
    )


def nearest(folders: DataFrame, configs: DataFrame) -> DataFrame:
    """(at, folder): for every folder `at` the deepest folder at or above it that has a configuration."""
    above = folders.select("at", F.posexplode(ancestors(F.col("at"))).alias("depth", "folder"))
    return above.join(configs.select("folder"), "folder").groupBy("at").agg(F.max_by("folder", "depth").alias("folder"))


def aliased(specs: DataFrame, configs: DataFrame) -> DataFrame:
    """specs (src, spec, ...) with base and rank: every path that the nearest configuration's patterns give, before endings are tried."""
    at = specs.select(folder(F.col("src")).alias("at")).distinct()
    own = specs.withColumn("at", folder(F.col("src"))).join(nearest(at, configs), "at").join(patterns(configs).withColumnRenamed("base", "root"), "folder")
    inner = F.length("spec") - F.length("before") - F.length("after")
    fits = F.when(F.col("starred"), F.startswith("spec", F.col("before")) & F.endswith("spec", F.col("after")) & (inner >= 0)).otherwise(F.col("spec") == F.col("before"))
    middle = F.substring(F.col("spec"), F.length("before") + 1, inner)
    star = F.instr("target", "*")
    filled = F.when(F.col("starred") & (star > 0), F.concat(F.substring(F.col("target"), F.lit(1), star - 1), middle, F.substring(F.col("target"), star + 1, F.length("target")))).otherwise(F.col("target"))
    return own.where(fits).select(*specs.columns, normal(F.concat_ws("/", "root", filled)).alias("base"), "rank")
