"""The toxicity classifier looks at all letters of a text."""

import itertools
import math
import random

import numpy as np
import pytest

from tidemark.llm import toxicity

CLEAN = ["meadow", "river", "lantern", "garden", "window", "kettle", "harbor", "pencil", "saddle", "walnut", "copper", "basket"]
INSULTS = ["grobnak", "fezzlurt", "skravvin"]


@pytest.fixture(scope="module")
def scorer():
    r = random.Random(1)
    texts, labels = [], []
    for n in range(240):
        words = [r.choice(CLEAN) for _ in range(r.choice([1, 2, 5, 20, 80]))]
        if n % 2:
            words[r.randrange(len(words))] = r.choice(INSULTS)
        texts.append(" ".join(words))
        labels.append(n % 2)
    return toxicity.Scorer(toxicity.fit(texts, labels))


def clean_run(letters, seed=2):
    r = random.Random(seed)
    return "".join(r.choice(CLEAN) for _ in range(letters // 6 + 1))[:letters]


@pytest.mark.parametrize("insult", INSULTS)
@pytest.mark.parametrize("letters", [500, 5000, 200_000])
def test_an_insult_at_the_end_of_a_long_token_is_seen(scorer, letters, insult):
    run = clean_run(letters)
    clean, toxic = scorer.score([run, run + insult])
    assert clean < 0.5 <= toxic


@pytest.mark.parametrize("joint", ["-", "_", "/", "."])
def test_an_insult_among_joined_words_is_seen(scorer, joint):
    r = random.Random(4)
    words = [r.choice(CLEAN) for _ in range(40)]
    clean, toxic = scorer.score([joint.join(words), joint.join([*words, INSULTS[0]])])
    assert clean < 0.5 <= toxic


@pytest.mark.parametrize("insult", INSULTS)
def test_an_insult_is_seen_behind_any_number_of_letters(scorer, insult):
    """Behind them, before them, and spelled letter by letter; the same letters without it are clean."""
    for n in range(1, 71):
        run, rest = clean_run(n, n), clean_run(9, n + 100)
        clean = scorer.score([run + rest, " ".join(run + rest)])
        toxic = scorer.score([run + insult, run + insult + rest, insult + run, " ".join(run + insult), " ".join(run + insult + rest)])
        assert (clean < 0.5).all() and (toxic >= 0.5).all(), n


def test_windows_have_the_letters_of_a_landmark():
    words = ["grobnak", "xxfezzlurtx", "xfezlurx", "xxscxumx", "xscmux", "xfezurtx", "xxgrobnakyy", "meadowgrobnka", "g", "robnakgro", "\u4e00" * 20 + "grobnek", "grob-nak", "ggrroobbnnaakk"]
    marks = toxicity.Landmarks(["grobnak", "scum", "abc", "fezzlurt"])
    want = set()
    for i, w in enumerate(words):
        for mark in ("grobnak", "scum", "fezzlurt"):
            for n in (len(mark), len(mark) + 1):
                if n < len(w):
                    want |= {(i, w[a : a + n]) for a in range(len(w) - n + 1) if len(set(mark) - set(w[a : a + n])) <= (len(set(mark)) >= 7)}
    assert set(marks.windows(words)) == want


def plain_score(model, text):
    """The score by plain loops: a word at a time, every window, no caches."""
    marks = toxicity.Landmarks(model.landmarks)
    near = [w for w, b in zip(model.landmarks, model.beta) if b > 0 and len(w) > toxicity.ORDER]

    def value(word):
        parts = {word if len(word) <= toxicity.DILUTED else ""}
        for mark in near:
            for n in (len(mark), len(mark) + 1):
                parts |= {word[a : a + n] for a in range(len(word) - n + 1) if n < len(word) and len(set(mark) - set(word[a : a + n])) <= (len(set(mark)) >= 7)}
        return max(float(marks.likeness([p])[0] @ model.beta) for p in parts)

    tokens = (text or "").split()
    words = [toxicity.normal(t) for t in tokens]
    values = [value(w) for w in words]
    if sum(len(w) == 1 for w in words) >= 4:
        for lone, own in itertools.groupby(range(len(words)), lambda i: len(words[i]) == 1):
            own = list(own)
            if lone and len(own) >= 4:
                values[own[0]] += value("".join(words[i] for i in own))
    sentences, at = [], []
    for i, t in enumerate(tokens):
        at.append(i)
        if t[-1] in ".!?" or len(at) == toxicity.LONGEST:
            sentences.append(at)
            at = []
    sentences += [at] if at else []
    margins = [sum(values[i] for i in own) + model.bias for own in sentences] or [model.bias]
    flagged = sum(m > 0 for m in margins) if tokens else 0
    n = max(len(tokens), 1)
    x = [max(margins), math.log1p(flagged), flagged / len(margins), sum(max(v + model.bias, 0) for v in values) / n, math.log1p(len(tokens))]
    z = sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.scale, model.logit)) + model.logit[-1]
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_are_those_of_plain_loops(scorer):
    r = random.Random(9)
    texts = [None, "", clean_run(30) + INSULTS[1], " ".join(clean_run(9)), "a b c d e. f g h i " + " ".join(INSULTS[2])]
    texts += ["".join(r.choice([*CLEAN, *INSULTS, "x"]) + r.choice([" ", " ", "-", ". ", "! "]) for _ in range(r.randrange(1, 90))) for _ in range(60)]
    assert scorer.score(texts) == pytest.approx([plain_score(scorer.model, t) for t in texts], abs=1e-4)


def test_a_scorer_forgets(scorer):
    """Whatever the texts: no more than `most` and one batch of tokens are kept."""
    small = toxicity.Scorer(scorer.model, most=500)
    texts = [" ".join(f"{w}{i}{n}" for w in CLEAN) for i in range(30) for n in range(4)] + [" ".join(f"lake{i}" for i in range(3000)) + " " + INSULTS[0]]
    found = []
    for _ in small.looked_up(texts, batch=200):
        found.append(len(small.known))
    assert max(found) <= 700
    assert small.score(texts) == pytest.approx(scorer.score(texts), abs=1e-5)


def test_texts_without_words(scorer):
    assert len({float(x) for x in scorer.score([None, "", "  "])}) == 1 and len(scorer.score([])) == 0


def test_words_met_again_after_their_tokens_went_are_not_evaluated_again(scorer):
    small, asked = toxicity.Scorer(scorer.model, most=50), []
    evaluated = small.marks.values
    small.marks.values = lambda words, beta: asked.extend(words) or evaluated(words, beta)
    texts = [" ".join(f"word{chr(97 + i)}{chr(97 + j)}" for j in range(20)) for i in range(3)]
    first = [small.features([t]) for t in texts]
    again = [small.features([t.upper() + "."]) for t in texts]
    assert len(asked) == len(set(asked)) == 60 and len(small.known) == 60
    np.testing.assert_allclose(np.vstack(first), np.vstack(again), atol=1e-6)
