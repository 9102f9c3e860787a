"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints within `k` differing bits are found by cutting the 64 bits into m parts with thresholds
t_1..t_m that sum to k - m + 1 (a part with -1 is not probed): any two fingerprints within k bits
then agree to within t_i bits on some part i. Correlated bits share a part, and the thresholds
minimise the estimated number of candidates, by dynamic programming over the parts.
"""

from __future__ import annotations

import functools
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, documents, forget_shuffles, free, stage

BITS = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash as a signed long; 0 for a text without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    # A text of any length is counted in slices, so memory stays bounded.
    counts, n, part = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for s in shingles:
        part.append(digest(s, 42))
        if len(part) == 65536:
            counts, n, part = counts + _bit_counts(part), n + len(part), []
    counts, n = counts + _bit_counts(part), n + len(part)
    bits = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def with_fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3, name: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(name, fp(F.col(text_col)))


# --- the plan of a search --------------------------------------------------------------------


def bit_statistics(fps: DataFrame, col: str = "fp") -> tuple[int, np.ndarray]:
    """Rows, and the 64 x 64 counts of bits set together, over all rows; 64 rows reach the driver."""

    def partial(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for pdf in batches:
            x = np.unpackbits(pdf[col].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(x), 8192):
                y = x[at : at + 8192]
                total += (y.T @ y).astype(np.int64)
            n += len(x)
        if n:
            yield pd.DataFrame({"bit": range(BITS), "n": n, "together": list(total)})

    sums = [F.sum(F.col("together")[j]).alias(f"b{j}") for j in range(BITS)]
    rows = fps.select(col).mapInPandas(partial, "bit int, n long, together array<long>").groupBy("bit").agg(F.sum("n").alias("n"), *sums).collect()
    out = np.zeros((BITS, BITS))
    for r in rows:
        out[r["bit"]] = [r[f"b{j}"] for j in range(BITS)]
    return (rows[0]["n"] if rows else 0), out


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into parts of equal width, each grown by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(var, var)
    left, out = list(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        seed = max(left, key=lambda b: (corr[b, left].sum(), -b))
        part = [seed]
        left.remove(seed)
        while len(part) < width:
            nxt = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            left.remove(nxt)
        out.append(sorted(part))
    return out


def expected_matches(n: int, together: np.ndarray, bits: list[int], threshold: int) -> float:
    """Estimated candidate pairs of one part: n^2/2 times the chance that two rows agree to within threshold.

    The chance follows from each bit's own agreement rate, damped by the part's mean correlation
    (correlated bits carry less than one bit each).
    """
    if threshold < 0:
        return 0.0
    p = np.diag(together)[bits] / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    chance = np.zeros(threshold + 1)
    chance[0] = 1.0
    for a in agree:
        chance = chance * a + np.concatenate([[0.0], chance[:-1]]) * (1 - a)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together[np.ix_(bits, bits)] / max(n, 1) - np.outer(p, p)) / np.outer(var, var)
    shared = (corr.sum() - np.trace(corr)) / max(len(bits) * (len(bits) - 1), 1)
    return n * n / 2 * float(chance.sum()) ** (1 - min(max(shared, 0), 0.9))


def probes(width: int, threshold: int) -> int:
    return sum(comb(width, r) for r in range(threshold + 1))


def allocate(costs: list[list[float]], k: int) -> list[int]:
    """Thresholds from -1 to k per part, summing to k - m + 1, of least total cost; costs[i][t + 1]."""
    m, goal = len(costs), k - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, k + 1):
                cand = (cost + row[t + 1], [*chosen, t])
                if total + t not in nxt or cand < nxt[total + t]:
                    nxt[total + t] = cand
        best = nxt
    assert goal in best, (m, k)
    return best[goal][1]


def plan_search(n: int, together: np.ndarray, k: int, most_parts: int = 5) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed part, for the number of parts of least estimated work.

    Work counts the candidates to verify and the keys that rows write and probe.
    """
    best = None
    for m in range(1, min(most_parts, k + 3) + 1):
        parts = group_bits(n, together, m)
        costs = [[0.0] + [expected_matches(n, together, p, t) + max(n, 1) * probes(len(p), t) for t in range(k + 1)] for p in parts]
        chosen = allocate(costs, k)
        cost = sum(c[t + 1] for c, t in zip(costs, chosen, strict=True))
        if best is None or cost < best[0]:
            best = (cost, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


# --- the search ------------------------------------------------------------------------------


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _flips(col: Column, bits: list[int], most: int) -> Column:
    """The array of all values that differ from col in up to `most` of these bits."""
    masks = [_mask(c) for r in range(most + 1) for c in combinations(bits, r)]
    return F.transform(F.array(*[F.lit(x) for x in masks]), lambda x: x.bitwiseXOR(col))


def near_pairs(nodes: DataFrame, k: int = 2, bucket_limit: int = 64, plan: list | None = None) -> DataFrame:
    """Edges (src, dst) over `nodes` (id, fp; distinct fps) that join all fps within k bits of each other.

    Buckets of up to bucket_limit rows are searched pair by pair and verified. In a larger bucket,
    pairs would grow with the square of its size; there every fp lists its neighbours within
    ceil(k/2) bits, and the fps that list one value are tied to the smallest of them. Two fps
    within k bits have a value within ceil(k/2) of both, and only such are within k bits for even k,
    so the links found imply the same components. Odd k needs the verified pairs of near values.
    """
    if k % 2:
        raise ValueError("an even number of bits is needed: large buckets are searched through midpoints")
    if plan is None:
        n, together = bit_statistics(nodes)
        plan = plan_search(n, together, k)
    keyed = None
    for no, (bits, threshold) in enumerate(plan):
        key = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        one = nodes.select(F.lit(no).alias("part"), key.alias("key"), "id", "fp")
        keyed = one if keyed is None else keyed.unionByName(one)
    keyed = stage(keyed, "simhash-keys")
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("size"))
    hot = stage(sizes.where(F.col("size") > bucket_limit).select("part", "key", F.lit(True).alias("hot")), "simhash-hot")
    marked = stage(keyed.join(hot, ["part", "key"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "simhash-marked")
    small = marked.where("not hot").drop("hot")

    pairs = None
    for no, (bits, threshold) in enumerate(plan):
        left = small.where(F.col("part") == no).select("key", F.col("id").alias("src"), F.col("fp").alias("fp1"))
        right = small.where(F.col("part") == no).select("key", F.col("id").alias("dst"), F.col("fp").alias("fp2"))
        if threshold:
            left = left.withColumn("key", F.explode(_flips(F.col("key"), bits, threshold)))
        near = (F.col("src") < F.col("dst")) & (F.bit_count(F.col("fp1").bitwiseXOR(F.col("fp2"))) <= k)
        one = left.join(right, "key").where(near).select("src", "dst")
        pairs = one if pairs is None else pairs.unionByName(one)
    # Rows of large buckets, and their neighbours in other parts, meet at midpoints. A pair whose part
    # is split over a large and a small bucket (threshold over 0) is met there too.
    reach = marked.where("hot").select("id", "fp")
    if any(t for _, t in plan):
        for no, (bits, threshold) in enumerate(plan):
            if threshold:
                around = hot.where(F.col("part") == no).select(F.explode(_flips(F.col("key"), bits, threshold)).alias("key")).distinct()
                reach = reach.unionByName(small.where(F.col("part") == no).join(around, "key", "left_semi").select("id", "fp"))
    mids = reach.distinct().select("id", F.explode(_flips(F.col("fp"), list(range(BITS)), k // 2)).alias("mid"))
    # At most 65 fps lie within one bit of a value, so these lists are bounded.
    stars = mids.groupBy("mid").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    stars = stars.select(F.col("ids")[0].alias("src"), F.explode(F.slice("ids", 2, 1 << 20)).alias("dst"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in edges (src < dst): label is the smallest id reachable.

    Alternating stars: each id ties its larger neighbours to the smallest one, then its smaller ones,
    until every component is one star. Paths halve each round, so long chains of near copies take
    rounds by their logarithm. Tables are written between rounds; one row with a count and a checksum
    of the edges reaches the driver. Hubs are met by partial aggregation and by joins of written
    tables, which AQE splits.
    """
    now, mark = stage(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")), "cc-edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        free(now)
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        free(large)
        seen = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if seen == mark:
            break
        mark = seen
    tops = now.select(F.col("v").alias("id")).distinct().withColumn("label", F.col("id"))
    found = stage(now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(tops), "cc-labels")
    free(now)
    return found


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, k: int = 2) -> DataFrame:
    """(row_id, fp, component_id) of every row: component_id is the smallest id reachable by links of k bits.

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other;
    a text of fewer words than a shingle is hashed whole; rows with a null id belong to the component
    of their fingerprint, which is null only where no row of it has an id; repeated rows and ids give
    a row each, and an id ties the fingerprints of its rows together where it is the least of both;
    an empty input gives an empty result; other columns are ignored.
    """
    rows = stage(with_fingerprints(docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("__text")), "__text", words).select("row_id", "fp"), "simhash-rows")
    per_fp = stage(rows.groupBy("fp").agg(F.min("row_id").alias("id")), "simhash-distinct")
    labels = components(near_pairs(per_fp.where("id is not null"), k))
    classes = stage(per_fp.join(labels, "id", "left").select("fp", F.coalesce("label", "id").alias("component_id")), "simhash-classes")
    free(per_fp, labels)
    return rows.join(classes, "fp").select("row_id", "fp", "component_id")


# --- near copies by similarity ---------------------------------------------------------------


_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    x = (x ^ (x >> np.uint64(27))) * _ODD[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the runs of `length` words, from the words' own hashes; of the whole where there are fewer words."""
    length = min(length, len(words))
    if not length:
        return words
    out = np.full(len(words) - length + 1, np.uint64(length)) * _MIX
    for i in range(length):
        out = _scrambled(out ^ words[i : len(words) - length + 1 + i]) + _ODD[i % len(_ODD)]
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z in lower case."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def shingle_set(words: np.ndarray, length: int = 5) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the word shingles, for Jaccard similarity. Fewer words: the whole; none: []."""
    return np.unique((shingle_hashes(words, length) >> np.uint64(32)).astype(np.uint32).view(np.int32))


def sign_bits(hashes: np.ndarray) -> int:
    """The SimHash of hashes, repeats included, as a signed long; 0 for none. Long texts are counted in slices."""
    if not len(hashes):
        return 0
    counts = sum(np.unpackbits(hashes[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for a in range(0, len(hashes), 65536))
    return int(np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _listed(nodes: DataFrame, plan: list, most: bool) -> DataFrame:
    """(part, key) with each node's columns: the keys that one side lists, the larger or the smaller half of the flips."""
    out = None
    for no, (bits, threshold) in enumerate(plan):
        flips = threshold - threshold // 2 if most else threshold // 2
        key = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        one = nodes.select(F.lit(no).alias("part"), F.explode(_flips(key, bits, flips)).alias("key"), *nodes.columns)
        out = one if out is None else out.unionByName(one)
    return out


def leader_pairs(nodes: DataFrame, k: int, plan: list, least: int = 8, leaders: int = 3) -> DataFrame:
    """(src, dst), at most one pair a node (no, fp): its nearest leader, within k bits, of the keys that more than `least` rows list.

    Pairs grow with the rows, not with the square of a group, and tie most of a large group together.
    """
    keys = _listed(nodes.select("no", "fp"), plan, False)
    lead = [F.min_by(F.struct("no", "fp"), F.xxhash64(F.lit(seed), "no")) for seed in range(leaders)]
    tops = keys.groupBy("part", "key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*lead)).alias("tops")).where(F.col("n") > least)
    tops = tops.select("part", "key", F.explode("tops").alias("top"))
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("top.fp")))
    met = keys.join(tops, ["part", "key"]).where((F.col("no") != F.col("top.no")) & (away <= k))
    best = met.groupBy("no").agg(F.min(F.struct(away.alias("away"), F.col("top.no").alias("to"))).alias("top"))
    return best.select(F.least("no", "top.to").alias("src"), F.greatest("no", "top.to").alias("dst")).distinct()


def _parity_away(a: str, b: str) -> Column:
    """Differing parity bits of two arrays of powers of two of longs; the longer one is folded to the shorter."""
    k = F.least(F.size(a), F.size(b))
    xor = lambda u, v: u.bitwiseXOR(v)
    folded = lambda c: F.when(F.size(c) > k, F.zip_with(F.slice(c, F.lit(1), k), F.slice(c, k + 1, k), xor)).otherwise(F.col(c))
    return F.aggregate(F.zip_with(folded(a), folded(b), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, x: total + x)


def similar_pairs(nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (src, dst) of nodes (no, n, fine, own) whose shingle sets have at least this Jaccard similarity; both are staged tables.

    Sets whose fine parity bits differ in more than two sets of this similarity can differ go first, so
    that whole sets only travel for pairs that are alike or nearly so.
    """
    one = lambda end, x: nodes.select(F.col("no").alias(end), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"fine{x}"))
    sized = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")
    # Arrays are a power of two long, so sizes within this ratio are one fold apart at most.
    near = _parity_away("finea", "fineb") * (1 + similarity) <= (F.col("na") + F.col("nb")) * (1 - similarity) + 1e-6
    likely = stage(pairs.join(one("src", "a"), "src").join(one("dst", "b"), "dst").where(sized).where(near).select("src", "dst"), "simhash-likely")
    used = stage(likely.select(F.explode(F.array("src", "dst")).alias("no")).distinct(), "simhash-used")
    sets = stage(nodes.select("no", "own").join(used, "no", "left_semi"), "simhash-shingles")
    both = likely.join(sets.select(F.col("no").alias("src"), F.col("own").alias("a")), "src").join(sets.select(F.col("no").alias("dst"), F.col("own").alias("b")), "dst")
    common = F.size(F.array_intersect("a", "b"))
    alike = common >= F.lit(similarity) * (F.size("a") + F.size("b") - common)
    found = stage(both.where(alike | (F.size("a") + F.size("b") == 0)).select("src", "dst").distinct(), "simhash-links")
    free(likely, used, sets)
    return found


#: Shingles are counted by so many values of their low bits.
COUNTED = 1 << 18


def shingle_counts(nodes: DataFrame, col: str = "own") -> np.ndarray:
    """How many shingles of all rows' sets have each of COUNTED values of the low bits; one table of that size reaches the driver."""
    width = 64

    def partial(batches):
        total = np.zeros(COUNTED, np.int64)
        for pdf in batches:
            sets = [np.asarray(x, np.int64) for x in pdf[col] if x is not None]
            if sets:
                total += np.bincount(np.concatenate(sets) & (COUNTED - 1), minlength=COUNTED)
        if total.any():
            yield pd.DataFrame({"part": range(COUNTED // width), "n": list(total.reshape(-1, width))})

    sums = [F.sum(F.col("n")[j]).alias(f"n{j}") for j in range(width)]
    out = np.zeros((COUNTED // width, width), np.int64)
    for r in nodes.select(col).mapInPandas(partial, "part int, n array<long>").groupBy("part").agg(*sums).collect():
        out[r["part"]] = r[1:]
    return out.ravel()


def shingle_places(counts: np.ndarray) -> np.ndarray:
    """The place of each value of the low bits in the order of shingles, the rarest first.

    Any order gives the same pairs, one that puts rare shingles first gives small buckets.
    """
    return np.unique(counts, return_inverse=True)[1].astype(np.int32)


def set_head(own: np.ndarray, similarity: float, places: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, by their places and then their values: two sets of this similarity share one of both heads."""
    most = len(own) - ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
    return own[np.argsort(places[own & (COUNTED - 1)], kind="stable")[:most]]


def parity_bits(x: np.ndarray, width: int) -> np.ndarray:
    """For each of `width` values of the low bits of x, whether an odd number of x has it."""
    return np.packbits((np.bincount(x & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").view("<i8")


def set_sketch(own: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(size, parity bits, fine parity bits) of a shingle set.

    The parity of shingles by 512 hash values differs between two sets in at most as many bits as the
    sets differ in shingles; the fine bits are by as many values as the set has shingles, or up to
    twice, 512 at least.
    """
    x = own.astype(np.int64)
    return len(x), parity_bits(x, 512), parity_bits(x, max(512, 1 << (len(x) - 1).bit_length() if len(x) else 0))


def _may_be_similar(similarity: float) -> Column:
    """No pair of this similarity fails it: by the shingles left after a shared one, and by parity bits. Columns of x and y."""
    both = F.col("x.n") + F.col("y.n")
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return (left * (1 + similarity) >= both * similarity - 1e-6) & (_away() * (1 + similarity) <= both * (1 - similarity) + 1e-6)


def _away() -> Column:
    """Differing parity bits of x and y."""
    return sum((F.bit_count(F.get("x.bits", F.lit(i)).bitwiseXOR(F.get("y.bits", F.lit(i)))) for i in range(1, 8)), F.bit_count(F.get("x.bits", F.lit(0)).bitwiseXOR(F.get("y.bits", F.lit(0)))))


def _as_pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.no", "y.no").alias("src"), F.greatest("x.no", "y.no").alias("dst")).distinct()


def mixed_keys(held: DataFrame) -> DataFrame:
    """(key, total) of the keys that rows of several classes hold."""
    ends = held.groupBy("key").agg(F.count("*").alias("total"), F.min("cls").alias("least"), F.max("cls").alias("most"))
    return ends.where("least <> most").select("key", "total")


def head_leader_pairs(held: DataFrame, similarity: float, least: int = 8, leaders: int = 3) -> DataFrame:
    """(src, dst), at most one pair a node: its nearest leader of another class, of the keys that more than `least` rows hold."""
    large = stage(mixed_keys(held).where(F.col("total") > least).select("key"), "simhash-large")
    rows = held.join(large, "key").select("key", F.struct("no", "cls", "n", "pos", "bits").alias("x"))
    lead = [F.min_by("x", F.xxhash64(F.lit(seed), "x.no")) for seed in range(leaders)]
    tops = rows.groupBy("key").agg(F.array_distinct(F.array(*lead)).alias("tops")).select("key", F.explode("tops").alias("y"))
    met = rows.join(tops, "key").where((F.col("x.cls") != F.col("y.cls")) & _may_be_similar(similarity))
    best = met.groupBy(F.col("x.no").alias("no")).agg(F.min(F.struct(_away().alias("away"), F.col("y.no").alias("to"))).alias("top"))
    return best.select(F.least("no", "top.to").alias("src"), F.greatest("no", "top.to").alias("dst")).distinct()


def head_pairs(held: DataFrame, similarity: float, block_rows: int = 2048) -> DataFrame:
    """All pairs (src, dst) of different classes that share a shingle of their heads and may be similar.

    Rows of a key's main class are not set against each other. Keys that many rows hold are cut into
    blocks of about block_rows rows of one side; every row of the other side visits each block.
    """
    per = held.groupBy("key", "cls").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("cls", F.struct("n", "cls")).alias("main"), F.count("*").alias("classes"), F.sum("n").alias("total"))
    mixed = stage(per.where("classes > 1").select("key", "main", F.ceil(F.col("total") / block_rows).cast("int").alias("blocks")), "simhash-mixed")
    rows = held.join(mixed, "key").select("key", "main", "blocks", F.struct("no", "cls", "n", "pos", "bits").alias("x"))
    few = rows.where("x.cls <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "block", "x")
    all_ = rows.select("key", F.pmod(F.xxhash64("x.no"), F.col("blocks")).cast("int").alias("block"), F.col("x").alias("y"), (F.col("x.cls") == F.col("main")).alias("of_main"))
    once = F.col("of_main") | (F.col("x.no") < F.col("y.no"))
    return _as_pairs(few.join(all_, ["key", "block"]).where((F.col("x.cls") != F.col("y.cls")) & once & _may_be_similar(similarity)))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, sketch_words: int = 2, k: int = 8) -> DataFrame:
    """(row_id, component_id) of every row: rows are linked by a Jaccard similarity of their word shingles.

    First the pigeonhole search: fingerprints of sketch_words-word shingles probe the keys of parts of
    unequal thresholds for leaders within k bits, so that a large group of near copies is tied
    together without all of its pairs. Then what fingerprints miss, exactly: with the shingles of each
    text in one order, the rarest of all texts first, texts of this similarity share one of the first of both (the head: a fifth of a
    text and one more, for 0.8). Only shingles that heads of several classes hold go on; candidates
    share one and pass two tests that no similar pair fails. Every link is verified on whole shingle
    sets, of 32-bit hashes: two texts of a thousand words have one false common shingle in 4000 pairs.

    Texts of equal words are one node. Null and empty texts, and texts of white space, are copies of
    each other; fewer words than a shingle count as one shingle; rows with a null id take the
    component of the rows of equal words, null where none has an id; rows that share an id share its
    component; an empty input gives an empty result; other columns are ignored.
    """
    words_of = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col("__text"), F.lit("")), _UPPER, _UPPER.lower()), BLANKS, " "))
    own = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("__text"))

    def sketched(text: str | None) -> tuple:
        hashed = word_hashes(text)
        shingles = shingle_set(hashed, words)
        return sign_bits(shingle_hashes(hashed, sketch_words)), *set_sketch(shingles), shingles

    @F.pandas_udf("fp long, n int, bits array<long>, fine array<long>, own array<int>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketched(t) for t in texts], columns=["fp", "n", "bits", "fine", "own"])

    texts = stage(own.select("row_id", F.unhex(F.md5(words_of)).alias("digest"), sketch("__text").alias("s")).select("row_id", "digest", "s.*"), "simhash-texts")
    # One row a text: rows of one digest hold the same, so any will do for what is not the id.
    each = F.min(F.when(F.col("row_id").isNotNull(), F.struct("row_id", "fp", "n", "bits", "fine", "own"))).alias("x")
    nodes = texts.groupBy("digest").agg(each).where("x is not null").select("digest", F.col("x.row_id").alias("id"), "x.fp", "x.n", "x.bits", "x.fine", "x.own")
    nodes = stage(nodes.withColumn("no", F.monotonically_increasing_id()), "simhash-nodes")
    rows = stage(texts.select("row_id", "digest"), "simhash-rows")
    free(texts)
    forget_shuffles(docs.sparkSession)

    def joined(cls: DataFrame, links: DataFrame) -> DataFrame:
        """cls (no, cls) after links: only classes that a link ties together are searched for components."""
        if links.isEmpty():
            return cls
        ends = links.join(cls.toDF("src", "a"), "src").join(cls.toDF("dst", "b"), "dst").where("a <> b")
        label = components(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        new = stage(cls.join(label.toDF("cls", "label"), "cls", "left").select("no", F.coalesce("label", "cls").alias("cls")), "simhash-joined")
        free(label, links, cls)
        return new

    def verified(pairs: DataFrame) -> DataFrame:
        candidates = stage(pairs, "simhash-candidates")
        links = similar_pairs(nodes, candidates, similarity)
        free(candidates)
        forget_shuffles(docs.sparkSession)
        return links

    # Rows of one id share its component, whatever their texts.
    first = nodes.groupBy("id").agg(F.min("no").alias("src"), F.count("*").alias("texts")).where("texts > 1")
    cls = joined(nodes.select("no", F.col("no").alias("cls")), nodes.select("id", F.col("no").alias("dst")).join(first, "id").where("src <> dst").select("src", "dst"))
    n, together = bit_statistics(nodes.select("fp"))
    cls = joined(cls, verified(leader_pairs(nodes, k, plan_search(n, together, k))))
    # Leaders only tie groups together early; head_pairs then meets every pair of what is still apart.
    places = shingle_places(shingle_counts(nodes))

    @F.pandas_udf("array<int>")
    def head(sets: pd.Series) -> pd.Series:
        return pd.Series([set_head(np.asarray(x, np.int32), similarity, places) for x in sets], dtype=object)

    first_of = stage(nodes.select("no", head("own").alias("head")), "simhash-heads")
    heads = first_of.join(cls, "no").select("no", "cls", F.posexplode("head").alias("pos", "key"))
    apart = stage(mixed_keys(heads).select("key"), "simhash-apart")
    held = stage(heads.drop("cls").join(apart, "key"), "simhash-held")
    free(apart, first_of)
    forget_shuffles(docs.sparkSession)
    for search in () if held.isEmpty() else (head_leader_pairs, head_pairs):
        met = stage(held.join(nodes.select("no", "n", "bits"), "no").join(cls, "no"), "simhash-met")
        links = verified(search(met, similarity))
        free(met)
        cls = joined(cls, links)
    named = nodes.select("no", "digest", "id").join(cls, "no")
    tops = named.groupBy("cls").agg(F.min("id").alias("component_id"))
    result = stage(named.join(tops, "cls").select("digest", "component_id"), "simhash-classes")
    free(cls, held, nodes)
    return rows.join(result, "digest", "left").select("row_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs whose id leads its component: one document of each group of near copies stays, with all its columns.

    Rows with a null id stay, as no id can name them the copy of another.
    """
    classes = similar_classes(docs, id_col, text_col, words, similarity)
    gone = classes.where("row_id <> component_id").select(F.col("row_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(documents(spark, sf_dir))
    return found.select(F.col("row_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_dedup": op10_simhash_dedup}
