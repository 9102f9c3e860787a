"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

score = logistic(b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pairwise term is taken in
linear time by the sum-of-squares identity: half of (sum v_i x_i)^2 - sum (v_i x_i)^2, per factor.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .toxicity import fold, sample

#: Hashed words take the first WORDS features; each statistic takes BINS more.
WORDS, BINS, FACTORS = 1 << 14, 12, 6
STATISTICS = ("symbols", "capitals", "digits", "blanks", "word_length", "distinct", "sentence_length", "line_length", "short_lines", "most_common", "repeated_lines", "long_words")


@dataclass
class Model:
    prior: float
    edges: np.ndarray | None = None  # (statistics, BINS - 1)
    bias: float = 0.0
    linear: np.ndarray | None = None
    factors: np.ndarray | None = None


def statistics(text: str, tokens: list[str], metadata: tuple[float, ...]) -> list[float]:
    """Structure of a text, in the order of STATISTICS, then the logarithms of the metadata."""
    n, k = max(len(text), 1), max(len(tokens), 1)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    lines = text.split("\n")
    counts = Counter(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1, np.int64)
    ends = hist[ord(".")] + hist[ord("!")] + hist[ord("?")]
    symbols = hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum() - hist[ord(".")] - hist[ord(",")]
    line_n = np.fromiter(map(len, lines), np.int64, len(lines))
    return [
        symbols / n,
        hist[65:91].sum() / n,
        hist[48:58].sum() / n,
        (hist[32] + hist[10] + hist[9] + hist[13]) / n,
        float(lengths.mean()),
        len(counts) / k,
        k / (ends + 1),
        float(np.log1p(line_n.mean())),
        float((line_n < 20).mean()),
        max(counts.values(), default=0) / k,
        1 - len(set(lines)) / len(lines),
        float((lengths > 15).mean()),
        *[float(np.log1p(max(x, 0.0))) if x == x else -1.0 for x in metadata],
    ]


class Featurizer:
    """Hashes of words; at most `most` of them are kept."""

    def __init__(self, most: int = 150_000):
        self.known: dict[str, int] = {}
        self.most = most

    def words(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for t in set(tokens):
            if t not in known:
                known[t] = zlib.crc32(t.lower().encode("utf-8", "surrogatepass")) % WORDS
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def raw(self, text: str | None, metadata: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Distinct hashed words, their values (unit length in all), and the statistics."""
        text = text or ""
        tokens = text.split()
        ids, n = np.unique(self.words(tokens), return_counts=True)
        x = np.log1p(n)
        return ids, x / max(float(np.sqrt((x * x).sum())), 1e-9), statistics(text, tokens, metadata)


def _binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature ids of the statistics' bins."""
    return np.stack([WORDS + j * BINS + np.searchsorted(edges[j], stats[:, j], side="right") for j in range(stats.shape[1])], axis=1)


def _row(model: Model, ids: np.ndarray, x: np.ndarray) -> float:
    v = model.factors[ids] * x[:, None]
    return model.bias + float(model.linear[ids] @ x) + 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())


def fit(rows: list[tuple[str | None, tuple[float, ...]]], labels: list[int], epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Model:
    """Adam on the logistic loss; the same rows give the same model. One class only: its share for all."""
    y = np.array(labels, np.float64)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if not 0 < y.sum() < len(y):
        return Model(prior)
    feat = Featurizer()
    raws = [feat.raw(t, m) for t, m in rows]
    stats = np.array([r[2] for r in raws])
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    bins = _binned(stats, edges)
    fields = bins.shape[1]
    n = WORDS + fields * BINS
    rng = np.random.default_rng(seed)
    model = Model(prior, edges, float(np.log(prior / (1 - prior))), np.zeros(n), rng.normal(0, 0.02, (n, FACTORS)))
    one = 1 / np.sqrt(fields)
    ids = [np.concatenate([r[0], b]) for r, b in zip(raws, bins, strict=True)]
    xs = [np.concatenate([r[1], np.full(fields, one)]) for r in raws]
    m1, v1 = np.zeros((n, FACTORS + 1)), np.zeros((n, FACTORS + 1))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            i = np.concatenate([ids[r] for r in part])
            x = np.concatenate([xs[r] for r in part])
            at = np.repeat(np.arange(len(part)), [len(ids[r]) for r in part])
            cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
            v = model.factors[i] * x[:, None]
            s = np.add.reduceat(v, cut)
            out = model.bias + np.add.reduceat(model.linear[i] * x, cut) + 0.5 * ((s**2).sum(1) - np.add.reduceat((v * v).sum(1), cut))
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]) / len(part)
            model.bias -= rate * 5 * float(g.sum())
            gx = g[at] * x
            grad = np.concatenate([gx[:, None], gx[:, None] * (s[at] - v)], axis=1)
            u, inv = np.unique(i, return_inverse=True)
            total = np.stack([np.bincount(inv, weights=grad[:, f], minlength=len(u)) for f in range(FACTORS + 1)], axis=1)
            total[:, 0] += 1e-5 * model.linear[u]
            total[:, 1:] += 1e-4 * model.factors[u]
            step += 1
            m1[u] = 0.9 * m1[u] + 0.1 * total
            v1[u] = 0.999 * v1[u] + 0.001 * total**2
            move = rate * (m1[u] / (1 - 0.9**step)) / (np.sqrt(v1[u] / (1 - 0.999**step)) + 1e-8)
            model.linear[u] -= move[:, 0]
            model.factors[u] -= move[:, 1:]
    return model


def score_texts(model: Model, texts: list[str | None], metadata: list[tuple[float, ...]], feat: Featurizer | None = None) -> np.ndarray:
    out = np.full(len(texts), model.prior)
    if model.factors is None or not len(texts):
        return out
    feat = feat or Featurizer()
    raws = [feat.raw(t, m) for t, m in zip(texts, metadata, strict=True)]
    bins = _binned(np.array([r[2] for r in raws]), model.edges)
    one = np.full(bins.shape[1], 1 / np.sqrt(bins.shape[1]))
    z = np.array([_row(model, np.concatenate([r[0], b]), np.concatenate([r[1], one])) for r, b in zip(raws, bins, strict=True)])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, metadata: tuple[str, ...] = ("n_chars",), text_col: str = "text", name: str = "quality") -> DataFrame:
    """docs with a score from 0 to 1. Null texts count as empty; null metadata has a bin of its own.

    Texts of any length are scored whole; equal texts with equal metadata get equal scores; an empty
    input gives an empty result; all columns are kept.
    """
    packed = pickle.dumps(model)

    @F.pandas_udf("double")
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        own, feat = pickle.loads(packed), Featurizer()  # live as long as their task
        for column, *others in batches:
            texts = list(column)
            rows = list(zip(*(c.astype("float64") for c in others), strict=True)) if others else [()] * len(texts)
            yield pd.Series(np.concatenate([score_texts(own, texts[a : a + 256], rows[a : a + 256], feat) for a in range(0, len(texts), 256)]) if texts else np.zeros(0))

    return docs.withColumn(name, apply(F.col(text_col), *[F.col(c) for c in metadata]))


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), most_docs: int = 4000) -> Model:
    """Fit on at most most_docs labelled documents outside the held-out fold (crc32 of the id mod 4 is 2).

    Labels of unknown ids and null labels are left out; an id labelled twice is good if one label
    says so; an id with several rows is learnt from the least of them. Without labels of both
    classes every text gets the share of the one there is, and a half where there is none.
    """
    own = sample(docs, labels, "quality", fold(F.col("__id"), 4) != 2, most_docs, ["text", *metadata])
    meta = list(zip(*(own[c].astype("float64") for c in metadata), strict=True)) if metadata else [()] * len(own)
    return fit(list(zip(own["text"], meta, strict=True)), list(own["label"]))


def op8_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op8_factorisation_quality": op8_factorisation_quality}
