"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A sequence costs linear * n + quadratic * n^2 summed over its pieces (attention stays within a
piece). Pieces of a full sequence stand alone. The tails are dealt by a hash into groups of bounded
size; in each group, documents in descending cost go to the cheapest sequence that still has room
for them, and those that fit nowhere whole are cut over the room that is left, cheapest first. A
group opens no more sequences than its tokens fill, so less than one sequence a group is padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .tokens import encoder

PIECES = "row_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def checksum(ids: bytes, count: int, start: int, length: int) -> int:
    """CRC-32 of part of `count` stored ids, as little-endian 32-bit words."""
    return zlib.crc32(np.frombuffer(ids, f"<u{len(ids) // count}")[start : start + length].astype("<u4"))


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of the pieces of items no longer than capacity."""
    total = int(lengths.sum())
    n = -(-total // capacity)
    used, cost = [0] * n, [0.0] * n
    price = lambda x: linear * x + quadratic * x * x
    heap = [(0.0, s) for s in range(n)]
    out, late = [], []
    for i in np.lexsort((np.arange(len(lengths)), -lengths)):
        size, passed, put = int(lengths[i]), [], False
        if not size:
            continue
        while heap:
            c, s = heapq.heappop(heap)
            if used[s] + size <= capacity:
                out.append((int(i), 0, size, s, used[s]))
                used[s] += size
                cost[s] = c + price(size)
                passed.append((cost[s], s))
                put = True
                break
            passed.append((c, s))
        for x in passed:
            if used[x[1]] < capacity:
                heapq.heappush(heap, x)
        if not put:
            late.append((int(i), size))
    for i, size in late:
        start = 0
        while start < size:
            c, s = heapq.heappop(heap)
            take = min(size - start, capacity - used[s])
            out.append((i, start, take, s, used[s]))
            used[s] += take
            start += take
            if used[s] < capacity:
                heapq.heappush(heap, (c + price(take), s))
    return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, group_bytes: int = 1 << 21, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """One row per piece: row_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text followed by end_id, so that null and empty texts
    give one id; every id is in one piece. Null ids are kept; repeated rows are documents of their
    own; texts of any length are cut into full sequences, dealt apart; an empty input gives an empty
    result; other columns are ignored. group_bytes is the mean text of a group, and so bounds its ids:
    pieces are dealt by a hash, and rows that repeat an id and a text by how often a task has met them.
    """
    texts = docs.select(F.col(id_col).cast("string").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    groups = max(1, -(-n_bytes // group_bytes))

    def encode(batches):
        enc = encoder(path)
        # How often this task has met a row: repeated rows are dealt apart. Equal rows are interchangeable, so
        # a task that is run again gives the same pieces whatever the order of its rows.
        met: Counter[tuple] = Counter()
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                out = []
                for rid, text in zip(part["row_id"], part["text"], strict=True):
                    ids = np.append(enc.encode(text), enc.dtype.type(end_id))
                    row = rid, zlib.crc32(ids.tobytes())
                    met[row] += 1
                    for no, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        # A full piece needs no partner: only its checksum travels.
                        data = own.tobytes() if len(own) < capacity else zlib.crc32(own.astype("<u4")).to_bytes(4, "little")
                        out.append((rid, met[row], no, start, len(ids), data, len(own)))
                yield pd.DataFrame(out, columns=["row_id", "copy", "no", "start", "doc_tokens", "ids", "length"])

    pieces = texts.mapInPandas(encode, "row_id string, copy long, no int, start long, doc_tokens long, ids binary, length long")
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("row_id", "copy", "no", F.crc32("ids")), F.lit(groups)).cast("int"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_id", "no", "doc_tokens"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        base = int(pdf["grp"].iloc[0]) << 32
        lengths = pdf["length"].to_numpy()
        full = int((lengths == capacity).sum())
        rows = [(i, 0, capacity, i, 0) for i in range(full)]
        rows += [(i + full, a, n, s + full, o) for i, a, n, s, o in assign(lengths[full:], capacity, linear, quadratic)]
        item = [r[0] for r in rows]
        own = pdf.iloc[item]
        crc = [int.from_bytes(pdf["ids"][i], "little") if i < full else checksum(pdf["ids"][i], int(lengths[i]), a, n) for i, a, n, _, _ in rows]
        return pd.DataFrame(
            {
                "row_id": own["row_id"].to_numpy(),
                "start": own["start"].to_numpy() + np.array([r[1] for r in rows]),
                "length": [r[2] for r in rows],
                "ids_crc32": crc,
                "doc_tokens": own["doc_tokens"].to_numpy(),
                "sequence_id": [base + r[3] for r in rows],
                "offset": [r[4] for r in rows],
            }
        )

    return grouped.groupBy("grp").applyInPandas(place, PIECES).withColumn("row_id", F.col("row_id").cast(docs.schema[id_col].dataType))


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("row_id", "doc_id")


QUERIES = {"op5_cost_balanced_packing": op5_cost_balanced_packing}
