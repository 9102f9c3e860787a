"""Exact token counts of texts of any length, by a byte-level BPE tokenizer.

Documents longer than a chunk are encoded as overlapping chunks with offsets. Neighbouring chunks are
spliced at a common token boundary that is proven stable: both encodings end a token there, and a
non-blank character meets a blank, where the pre-tokenizer always breaks and starts afresh, so the
tokens on either side cannot depend on what lies beyond. Where an overlap has none, it is widened,
up to the whole text.

Shorter documents are encoded whole, without offsets. A plain byte-level BPE is fully given by the
ranks of its merges, so an encoder by ranks gives the library's ids at half the cost or less, and
holds nothing but the vocabulary: workers keep no cache that grows.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: How a plain byte-level pre-tokenizer cuts texts: contractions, letters, digits, other signs, blanks.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoder(path: str) -> "Encoder":
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def by_ranks(path: str):
    """An encoder by merge ranks with the ids of this file, or None where the file is not a plain byte-level BPE.

    Plain: no normaliser, no post-processor, the pattern CUT, every token but the 256 bytes made by one
    merge, ids in the order of merges, and one special string at most.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    special = {t["content"]: t["id"] for t in added}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    made = [vocab.get("".join(m), -1) for m in merges]
    plain = (
        spec["normalizer"] is None
        and spec["post_processor"] is None
        and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and made == sorted(set(made))
        and len(vocab) == 256 + len(made)
        and len(added) <= 1
        and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        return None
    import tiktoken

    own = _bytes_of_letters()
    return tiktoken.Encoding(path, pat_str=CUT, mergeable_ranks={bytes(own[c] for c in t): i for t, i in vocab.items()}, special_tokens=special)


class Encoder:
    """ids without begin or end tokens; special strings inside texts are tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        self.path, self.ranked = path, by_ranks(path)
        self.size = self.ranked.n_vocab if self.ranked else self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    @functools.cached_property
    def library(self):
        """The library's own tokenizer, loaded where offsets are needed."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def encode(self, text: str) -> np.ndarray:
        if self.ranked:
            return self.ranked.encode_to_numpy(text, allowed_special="all").astype(self.dtype)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)


def stable(text: str, at: int) -> bool:
    """True where a non-blank character meets a blank: a pre-token ends and the next starts afresh."""
    return 0 < at < len(text) and text[at] in " \t\n\r" and not text[at - 1].isspace() and text[at - 1] not in "\x1c\x1d\x1e\x1f"


def count_by_chunks(library, text: str, chunk: int = 1 << 15, overlap: int = 256) -> tuple[int, int]:
    """(tokens, widenings) of a text, from overlapping chunks spliced at common stable boundaries."""
    n = len(text)
    total, widened, begin, core = 0, 0, 0, 0  # begin: the last splice
    while True:
        core = max(core, begin) + chunk
        if core >= n:
            return total + len(library.encode(text[begin:], add_special_tokens=False).ids), widened
        reach = overlap
        while True:
            # The left chunk ends `reach` after the cut, the right one starts `reach` before it.
            lo, hi = max(begin, core - reach), min(n, core + reach)
            left = library.encode(text[begin:hi], add_special_tokens=False).offsets
            right = library.encode(text[lo : min(n, hi + reach)], add_special_tokens=False).offsets
            ends = {begin + b for _, b in left}
            starts = {lo + a for a, _ in right} & {begin + a for a, _ in left}
            common = [p for p in ends & starts if lo < p < hi and stable(text, p)]
            if common:
                splice = min(common, key=lambda p: (abs(p - core), p))
                total += sum(begin + b <= splice for _, b in left)
                begin = splice
                break
            if hi == n:
                return total + len(left), widened
            reach, widened = reach * 2, widened + 1


def token_counts(docs: DataFrame, path: str, text_col: str = "text", name: str = "n_tokens", chunk: int = 1 << 15, overlap: int = 256) -> DataFrame:
    """docs with the number of tokens of each whole text.

    Null texts count as empty and have no tokens; texts of any length are counted exactly, with
    memory for one text and one widened chunk; special strings inside texts are tokens as the library
    has it by default; an empty input gives an empty result; all columns are kept.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        texts = ["" if t is None else t for t in texts]
        return pd.Series([len(enc.encode(t)) if len(t) <= chunk else count_by_chunks(enc.library, t, chunk, overlap)[0] for t in texts], dtype="int64")

    return docs.withColumn(name, count(F.col(text_col)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUERIES = {"op2_token_counts": op2_token_counts}
