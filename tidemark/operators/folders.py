"""Files in a few groups by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import saved

# Groups at most and at least, and the share of files from which a folder is split.
MOST_GROUPS, LEAST_GROUPS, DOMINANT, MOST_SPLITS = 16, 3, 0.5, 64
ROOT, OTHER = "", "(other)"


def folder_groups(files: DataFrame) -> DataFrame:
    """(path_id, grp): files by their top folder, the fullest folder split again and again where it dominates.

    A folder is split into its folders ("a/b") and the files that lie in it ("a/"); files at the top are
    the group "". Splits go on while there are fewer than LEAST_GROUPS groups or the fullest one that
    has folders holds over DOMINANT of all files, up to MOST_GROUPS groups; beyond these the smallest
    are one group, OTHER. Folders are counted in one job; of each folder that is split, no more than
    MOST_GROUPS + 1 children, the fullest, reach the driver, as more can never be groups.
    """
    seg = F.split("path", "/")
    depths = files.select(seg.alias("seg"), F.explode(F.sequence(F.lit(0), F.size(seg) - 1)).alias("depth"))
    parent = F.array_join(F.slice("seg", F.lit(1), F.col("depth")), "/")
    direct = F.col("depth") == F.size("seg") - 1
    child = F.when(direct & (F.col("depth") == 0), ROOT).when(direct, F.concat(parent, F.lit("/"))).otherwise(F.array_join(F.slice("seg", F.lit(1), F.col("depth") + 1), "/"))
    # The root's folders have the parent "/", which no path has.
    kids = saved(depths.groupBy(F.when(F.col("depth") == 0, "/").otherwise(parent).alias("parent"), child.alias("child")).agg(F.count("*").alias("n")))

    def children(of: str) -> dict[str, int]:
        rows = kids.where(F.col("parent") == F.lit(of)).orderBy(F.desc("n"), "child").limit(MOST_GROUPS + 1).collect()
        return {r["child"]: r["n"] for r in rows}

    total = kids.where("parent = '/'").agg(F.sum("n")).first()[0] or 0
    groups = children("/")
    for _ in range(MOST_SPLITS):
        if len(groups) >= MOST_GROUPS:
            break
        split = None
        for key in sorted((k for k in groups if k != ROOT and not k.endswith("/")), key=lambda k: (-groups[k], k)):
            below = children(key)
            if set(below) != {f"{key}/"}:
                split = key, below
                break
        if split is None or not (len(groups) < LEAST_GROUPS or groups[split[0]] > DOMINANT * total):
            break
        del groups[split[0]]
        groups |= split[1]
    kept = sorted(groups, key=lambda k: (-groups[k], k))
    kept = kept if len(kept) <= MOST_GROUPS else kept[: MOST_GROUPS - 1]
    grp = F.lit(OTHER)
    folder = F.array_join(F.slice(seg, F.lit(1), F.size(seg) - 1), "/")
    for key in kept:
        here = ~F.contains("path", F.lit("/")) if key == ROOT else folder == key[:-1] if key.endswith("/") else F.startswith("path", F.lit(f"{key}/"))
        grp = F.when(here, key).otherwise(grp)
    return files.select("path_id", grp.alias("grp"))
