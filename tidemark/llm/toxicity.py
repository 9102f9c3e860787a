"""Toxicity by a support vector machine over a gapped-subsequence string kernel.

Two words are alike as far as they share subsequences of ORDER characters (the start of a word is a
character too), each weighted by DECAY to its span, so inserted and dropped characters cost little.
The kernel of two sentences sums a power of that likeness over all pairs of their words. Nyström
landmarks (single words, chosen from labelled texts) make it a finite feature map; since the map is a
sum over words, a sentence's margin is the sum of its words' values, and a distinct word is
evaluated once per worker. Sentences learn from their document's label: in toxic documents, those
that score highest are the positive ones. A document's score is a logistic function of its
sentences' margins.
"""

from __future__ import annotations

import functools
import itertools
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ORDER, DECAY, SPAN, POWER = 3, 0.7, 6, 4  # likeness() squares twice
#: Letters: 1-26, others share OTHER codes; 0 is the start of a word.
OTHER = 9
ALPHABET = 27 + OTHER
#: Letters of words that are compared at once.
PIECE = 1 << 14
#: Of so many kinds of letters, a window may lack one.
MANY = 7
#: A word of more letters is diluted below a thousandth of any landmark, so only its windows have a value.
DILUTED = 64
#: A sentence ends at . ! ? or after so many words.
LONGEST = 40
#: Marks around words, none of which is a letter.
MARKS = ".,;:!?'\"()-"
# Characters that stand for letters inside words.
LOOKALIKES = str.maketrans("013457@$", "oieastas")


def _codes(words: list[str]) -> np.ndarray:
    """(words, letters + 1) of words of one length: the codes of the start and of each letter."""
    out = np.zeros((len(words), len(words[0]) + 1), np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.int64)
    out[:, 1:] = np.where((chars >= 97) & (chars <= 122), chars - 96, 27 + chars % OTHER)
    return out


def normal(token: str) -> str:
    """The letters of a token in lower case; look-alikes count as letters only between letters."""
    low = token.lower()
    if low.isalpha():
        return low
    bare = low.strip(MARKS)
    if bare.isalpha():
        return bare
    first = next((i for i, c in enumerate(low) if c.isalpha()), len(low))
    last = next((i for i in range(len(low) - 1, -1, -1) if low[i].isalpha()), -1)
    return "".join(c for c in low[first : last + 1].translate(LOOKALIKES) if c.isalpha())


@functools.cache
def _shape(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples within SPAN of each other in a word of n characters, and their weights."""
    own = [c for i in range(n) for c in ((i, *r) for r in itertools.combinations(range(i + 1, min(n, i + SPAN)), ORDER - 1))]
    if not own:
        return np.zeros((0, ORDER), np.int64), np.zeros(0, np.float32)
    at = np.array(own)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1 - ORDER)).astype(np.float32)


def _repeating_norms(feats: np.ndarray, weight: np.ndarray) -> np.ndarray:
    order = np.argsort(feats, axis=1)
    own = np.take_along_axis(feats, order, 1)
    run = np.cumsum(weight[order], axis=1, dtype=np.float64)
    last = np.ones(feats.shape, bool)
    last[:, :-1] = own[:, 1:] != own[:, :-1]
    r, c = np.nonzero(last)
    ends = run[r, c]
    before = np.concatenate([[0.0], ends[:-1]])
    before[np.concatenate([[True], r[1:] != r[:-1]])] = 0.0
    return np.sqrt(np.bincount(r, weights=(ends - before) ** 2, minlength=len(feats)))


def subsequences(words: list[str]):
    """Yields (rows, features, weights, norms) by word length: features (rows, triples)."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w) + 1, []).append(i)
    for n, rows in by.items():
        at, weight = _shape(n)
        if not len(at):
            continue
        step = max(1, 400_000 // len(at))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            codes = _codes([words[i] for i in part])
            feats = (codes[:, at[:, 0]] * ALPHABET + codes[:, at[:, 1]]) * ALPHABET + codes[:, at[:, 2]]
            # Norm: a subsequence that occurs more than once counts with the sum of its weights. None does without a repeated letter.
            norm = np.full(len(part), np.sqrt((weight.astype(np.float64) ** 2).sum()))
            again = np.flatnonzero((np.diff(np.sort(codes, axis=1), axis=1) == 0).any(1))
            if len(again):
                norm[again] = _repeating_norms(feats[again], weight)
            yield part, feats, weight, norm


@dataclass
class Landmarks:
    """near: the landmarks that windows are looked for (None: all)."""

    words: list[str]
    near: list[str] | None = None
    place: np.ndarray = field(init=False)  # of each feature in the table; 0: no landmark has it
    table: np.ndarray = field(init=False)  # (features of landmarks, landmarks)
    masks: dict[int, np.ndarray] = field(init=False)  # by length of window: the letters of landmarks
    longest: int = field(init=False)

    def __post_init__(self):
        own = [w for w in (self.words if self.near is None else self.near) if len(w) > ORDER]
        self.longest = max(map(len, own), default=ORDER) + 1
        found: dict[int, set[int]] = {}
        for w in own:
            mask = int(np.bitwise_or.reduce(np.left_shift(1, _codes([w])[0, 1:])))
            for n in (len(w), len(w) + 1):
                found.setdefault(n, set()).add(mask)
        self.masks = {n: np.array(sorted(masks)) for n, masks in found.items()}
        own = list(subsequences(self.words))
        held = np.unique(np.concatenate([f.ravel() for _, f, _, _ in own])) if own else np.zeros(0, np.int64)
        self.place = np.zeros(ALPHABET**ORDER, np.int32)
        self.place[held] = np.arange(1, len(held) + 1)
        self.table = np.zeros((len(held) + 1, len(self.words)), np.float32)
        for rows, feats, weight, norm in own:
            for i, f, n in zip(rows, feats, norm, strict=True):
                np.add.at(self.table[:, i], self.place[f], weight / n)

    def likeness(self, words: list[str]) -> np.ndarray:
        """(words, landmarks): POWER of the normalised kernel."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        for rows, feats, weight, norm in subsequences(words):
            at = self.place[feats]
            for a in range(0, len(rows), 64):  # what is gathered stays in a core's cache
                out[rows[a : a + 64]] = np.matmul(weight, self.table[at[a : a + 64]]) / norm[a : a + 64, None]
        np.multiply(out, out, out=out)
        np.multiply(out, out, out=out)
        return out

    def windows(self, words: list[str]) -> Iterator[tuple[int, str]]:
        """(number of the word, part): the parts of words that may be near a landmark, of its length or one letter more.

        Every letter of a word starts one; it counts where it has all kinds of the landmark's letters, or
        all but one of MANY, which comparisons of bit sets tell for all words of one length at once.
        """
        by: dict[int, list[tuple[int, str]]] = {}
        for i, w in enumerate(words):
            for a in range(0, len(w), PIECE):
                own = w[a : a + PIECE + self.longest]
                by.setdefault(len(own), []).append((i, own))
        for size, own in by.items():
            step = max(1, PIECE // size)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                bits = np.left_shift(1, _codes([w for _, w in part])[:, 1:])
                held = bits
                for n in range(1, min(self.longest, size - 1) + 1):
                    if n > 1:
                        held = held[:, :-1] | bits[:, n - 1 :]
                    if n in self.masks:
                        near, lacks = np.zeros(held.shape, bool), ~held
                        for mask in self.masks[n]:
                            lacking = lacks & mask
                            near |= (lacking & (lacking - 1) if mask.bit_count() >= MANY else lacking) == 0
                        for r, c in np.argwhere(near).tolist():
                            yield part[r][0], part[r][1][c : c + n]

    def over_windows(self, words: list[str], reduce) -> Iterator[tuple[int, np.ndarray]]:
        """(number of a word, reduce(likeness) of one of its windows); each distinct window of a batch is evaluated once."""
        for batch in itertools.batched(self.windows(words), 1 << 14):
            known = {p: i for i, p in enumerate(dict.fromkeys(p for _, p in batch))}
            got = reduce(self.likeness(list(known)))
            yield from ((i, got[known[p]]) for i, p in batch)

    def own_likeness(self, words: list[str]) -> np.ndarray:
        return self.likeness([w if len(w) <= DILUTED else "" for w in words])

    def best_likeness(self, words: list[str]) -> np.ndarray:
        """(words, landmarks): the best likeness of each word or of its windows."""
        out = self.own_likeness(words)
        for i, like in self.over_windows(words, lambda x: x):
            np.maximum(out[i], like, out=out[i])
        return out

    def values(self, words: list[str], beta: np.ndarray) -> np.ndarray:
        """The value of each word: its own, or that of its best window where that is more."""
        out = self.own_likeness(words) @ beta
        for i, value in self.over_windows(words, lambda x: x @ beta):
            out[i] = max(out[i], value)
        return out


@dataclass
class Model:
    """score() of documents; prior is the score of a text without words."""

    prior: float
    landmarks: list[str] = field(default_factory=list)
    beta: np.ndarray | None = None
    bias: float = 0.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    logit: np.ndarray | None = None


class Scorer:
    """Values of tokens; texts are scored whole. At most `most` tokens are kept, a few ten megabytes.

    Tokens of one word, and those met again after they were forgotten, take the word's value: values of
    words are kept in two generations of at most `most` and one batch, of which the older goes.
    """

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most = model, most
        # A window counts where it is worth more than its word, so only landmarks that weigh for a label can matter.
        self.marks = Landmarks(model.landmarks, [w for w, b in zip(model.landmarks, model.beta, strict=True) if b > 0]) if model.landmarks else None
        self.worth: dict[str, float] = {}
        self.older: dict[str, float] = {}
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.values = np.zeros(1 << 16, np.float32)
        self.ends = np.zeros(1 << 16, bool)
        self.lone = np.zeros(1 << 16, bool)

    def learn(self, tokens: list[str]) -> None:
        missing = list(set(tokens).difference(self.known))
        if not missing:
            return
        words = [normal(t) for t in missing]
        value = self.word_values(words)
        at, n = len(self.known), len(self.known) + len(missing)
        while n > len(self.values):
            self.values, self.ends, self.lone = (np.concatenate([x, np.zeros_like(x)]) for x in (self.values, self.ends, self.lone))
        self.values[at:n] = [value[w] for w in words]
        self.ends[at:n] = [t[-1] in ".!?" for t in missing]
        self.lone[at:n] = [len(w) == 1 for w in words]
        self.known.update(zip(missing, range(at, n), strict=True))

    def word_values(self, words: list[str]) -> dict[str, float]:
        """The value of each of the words; those that are not kept are evaluated together."""
        if len(self.worth) > self.most:
            self.older, self.worth = self.worth, {}
        value = self.worth
        new = []
        for w in dict.fromkeys(words):
            if w not in value:
                if (v := self.older.get(w)) is None:
                    new.append(w)
                else:
                    value[w] = v
        if new:
            value.update(zip(new, self.marks.values(new, self.model.beta).tolist() if self.marks else itertools.repeat(0.0), strict=bool(self.marks)))
        return value

    def looked_up(self, texts: list[str | None], batch: int = 1 << 16) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: its tokens, their values, whether they end a sentence, whether they are one letter.

        Texts are learnt together up to `batch` tokens, longer ones in parts, and all is forgotten before
        more than `most` and one batch would be kept.
        """

        def found(tokens: list[str]) -> tuple:
            if len(self.known) > self.most:
                self.forget()
            self.learn(tokens)
            at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
            return self.values[at], self.ends[at], self.lone[at]

        def flush() -> Iterator:
            all_ = found([t for ts in held for t in ts])
            at = np.cumsum([0, *map(len, held)])
            yield from ((ts, *(x[a:z] for x in all_)) for ts, a, z in zip(held, at, at[1:], strict=False))

        held: list[list[str]] = []
        for text in texts:
            ts = (text or "").split()
            if sum(map(len, held)) + len(ts) > batch and held:
                yield from flush()
                held = []
            if len(ts) > batch:
                parts = [found(ts[a : a + batch]) for a in range(0, len(ts), batch)]
                yield ts, *(np.concatenate(x) for x in zip(*parts, strict=True))
            else:
                held.append(ts)
        if held:
            yield from flush()

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: best margin, log of flagged sentences, their share, mean positive word value, log of words."""
        out = np.zeros((len(texts), 5))
        bias = self.model.bias
        for i, (ts, v, ends, lone) in enumerate(self.looked_up(texts)):
            if not ts:
                out[i, 0] = bias
                continue
            if lone.sum() >= 4:
                v = self.spelled(ts, v, lone)
            begin = np.zeros(len(ts), bool)
            begin[0], begin[1:] = True, ends[:-1]
            run = np.arange(len(ts)) - np.maximum.accumulate(np.where(begin, np.arange(len(ts)), 0))
            starts = np.flatnonzero(run % LONGEST == 0)
            margin = np.add.reduceat(v, starts) + bias
            flagged = int((margin > 0).sum())
            # A word alone reaches the margin where its value outweighs the bias.
            hits = float(np.maximum(v + bias, 0).sum())
            out[i] = margin.max(), np.log1p(flagged), flagged / len(starts), hits / len(ts), np.log1p(len(ts))
        return out

    def spelled(self, ts: list[str], v: np.ndarray, lone: np.ndarray) -> np.ndarray:
        """Letters spaced out as words: a run of four or more counts as the word they spell."""
        v = v.copy()
        edge = np.flatnonzero(np.diff(np.concatenate([[0], lone.astype(np.int8), [0]])))
        for a, z in edge.reshape(-1, 2):
            if z - a >= 4:
                word = "".join(normal(t) for t in ts[a:z])
                v[a] += self.marks.values([word], self.model.beta)[0] if self.marks else 0.0
        return v

    def score(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        if m.logit is None:
            return np.full(len(texts), m.prior)
        x = (self.features(texts) - m.mean) / m.scale
        return 1 / (1 + np.exp(-np.clip(x @ m.logit[:-1] + m.logit[-1], -30, 30)))


def _sentences(text: str | None, known: dict[str, str]) -> list[list[str]]:
    """known: one copy of each word, shared by all texts."""
    out, now = [], []
    for t in (text or "").split():
        w = normal(t)
        now.append(known.setdefault(w, w))
        if t[-1] in ".!?" or len(now) == LONGEST:
            out.append(now)
            now = []
    return [*out, now] if now else out


def choose_landmarks(docs: list[set[str]], toxic: np.ndarray, most: int = 56, background: int = 12) -> list[str]:
    """Words that tell toxic documents apart and are not near copies of each other, and common ones."""
    pos, neg = Counter(), Counter()
    for words, y in zip(docs, toxic, strict=True):
        (pos if y else neg).update(words)
    n1, n0 = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)

    def z(w):
        p1, p0 = (pos[w] + 0.1) / (n1 + 1), (neg[w] + 0.1) / (n0 + 1)
        p = (pos[w] + neg[w] + 0.2) / (n1 + n0 + 2)
        return (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))

    ranked = sorted((w for w in pos if len(w) >= ORDER and pos[w] >= 3), key=lambda w: (-z(w), w))[:240]
    common = [w for w, _ in sorted((pos + neg).items(), key=lambda x: (-x[1], x[0])) if len(w) >= ORDER and z(w) < 2][:background]
    chosen = common[:1] or ranked[:1]
    like = Landmarks(ranked + common).likeness(ranked + common) if chosen else np.zeros((0, 0))
    at = {w: i for i, w in enumerate(ranked + common)}
    for w in ranked + common[1:]:
        if len(chosen) >= most and w not in common:
            continue
        if max(like[at[w], at[c]] for c in chosen) < 0.5:
            chosen.append(w)
    return chosen


def _newton(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 15) -> np.ndarray:
    """Linear SVM with squared hinge loss; the last column of z is the bias, not regularised."""
    w = np.zeros(z.shape[1])
    reg = np.full(z.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(rounds):
        active = y * (z @ w) < 1
        za, ya, wa = z[active], y[active], weight[active]
        new = np.linalg.solve((za * wa[:, None]).T @ za + np.diag(reg), (za * wa[:, None]).T @ ya)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, reg = np.zeros(x.shape[1]), np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, x.T @ (y - p) - reg * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str | None], labels: list[int], rounds: int = 4) -> Model:
    """Train on whole labelled texts. With one class only, every score is the share of that class."""
    y = np.array(labels, np.float64)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    known: dict[str, str] = {}
    cut = [_sentences(t, known) for t in texts]
    marks = choose_landmarks([{w for s in d for w in s} for d in cut], y) if 0 < y.sum() < len(y) else []
    if not marks:
        return Model(prior)
    lm = Landmarks(marks)
    values, vectors = np.linalg.eigh(lm.likeness(marks).astype(np.float64) + 1e-3 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    own = [(i, s) for i, d in enumerate(cut) for s in d]
    words = list(dict.fromkeys(w for _, s in own for w in s))
    like, at = lm.best_likeness(words), {w: i for i, w in enumerate(words)}
    z = np.ones((len(own), len(marks) + 1), np.float32)
    for n, (_, s) in enumerate(own):
        z[n, :-1] = like[[at[w] for w in s]].sum(0) @ root
    doc = np.array([i for i, _ in own])
    del cut, own, like, words, at, known
    toxic = y[doc] > 0
    per = np.bincount(doc, minlength=len(y))[doc]
    use, target, weight = np.ones(len(doc), bool), np.where(toxic, 1.0, -1.0), np.where(toxic, 1.0 / per, 0.0)
    weight[~toxic] = toxic.any() * weight.sum() / max((~toxic).sum(), 1)
    for no in range(rounds):
        w = _newton(z[use], target[use], weight[use], 0.01 if no else 1.0)
        margin = z @ w
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, doc, margin)
        # Positive: the best of each toxic document and whatever else scores high there.
        use = ~toxic | (margin >= best[doc] - 1e-9) | (margin > 0)
        n_pos = max((use & toxic).sum(), 1)
        weight = np.where(toxic, 1.0, n_pos / max((~toxic).sum(), 1) * 4)
    model = Model(prior, marks, (root @ w[:-1]).astype(np.float32), float(w[-1]))
    x = Scorer(model).features(texts)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    model.logit = _logistic((x - model.mean) / model.scale, y)
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, columns: list[str], id_col: str = "doc_id") -> pd.DataFrame:
    """Up to `most` labelled rows, by a hash of the id: the bounded sample a classifier is fitted on. One row an id."""
    own = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label).cast("int").alias("__label")).where(F.col("__label").isNotNull() & F.col("__id").isNotNull() & usable)
    own = own.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64(F.lit(11), "__id"), "__id").limit(most)
    # Only the columns that are read, so that others of the same names do not clash.
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), *columns)
    found = docs.join(F.broadcast(own), "__id").groupBy("__id", "__label").agg(F.min(F.struct(*columns)).alias("__row")).select("__id", F.col("__label").alias("label"), "__row.*")
    return found.toPandas().sort_values("__id", kind="stable").reset_index(drop=True)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1. Null and empty texts have no words and get the score that implies.

    Texts of any length are scored whole, words of any length also by the best of their windows; equal texts get equal scores; an empty input gives an empty result; all columns are kept.
    """
    packed = pickle.dumps(model)

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(pickle.loads(packed))  # lives as long as its task
        for texts in map(list, batches):
            yield pd.Series(np.concatenate([scorer.score(texts[a : a + 256]) for a in range(0, len(texts), 256)]) if texts else np.zeros(0))

    return docs.withColumn(name, apply(F.col(text_col)))


def fold(id_col: Column, modulus: int) -> Column:
    return F.crc32(id_col.cast("string")) % modulus


def train(docs: DataFrame, labels: DataFrame, most_docs: int = 1500) -> Model:
    """Fit on all sentences of at most most_docs labelled documents outside the held-out fold (crc32 of the id mod 5 is 0).

    Labels of unknown ids and null labels are left out; an id labelled twice is toxic if one label
    says so; an id with several texts is learnt from the least of them. Without labels of both
    classes every text gets the share of the one there is, and a half where there is none.
    """
    own = sample(docs, labels, "toxic", fold(F.col("__id"), 5) != 0, most_docs, ["text"])
    return fit(list(own["text"]), list(own["label"]))


def op7_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_string_kernel_toxicity": op7_string_kernel_toxicity}
