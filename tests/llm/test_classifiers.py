"""The trained classifiers against plain computations of the same formulas."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wirelake.llm import langid, quality


def grams(text, most):
    """The set of n-grams of one to ``most`` characters; what is no letter counts as one blank, none at the beginning."""
    plain = re.sub(r"[\W\d_]+", " ", text.lower()).lstrip(" ")
    return {plain[k : k + n] for n in range(1, most + 1) for k in range(len(plain) - n + 1)}


def kernel(a, b):
    return np.array([[len(x & y) / math.sqrt(max(len(x), 1) * max(len(y), 1)) for y in b] for x in a])


@pytest.mark.parametrize("landmarks", [500, 12])
def test_kernel_ridge_against_a_dense_solver(landmarks):
    rng = random.Random(2)
    parts = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["ño", "ción", "ka"]}
    langs = [rng.choice(["aa", "aa", "bb", "cc"]) for _ in range(60)]
    text = lambda c: rng.choice(["", "12 "]) + rng.choice([" ", ", ", " 7-"]).join("".join(rng.choices(parts[c], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 15)))
    train, asked = [text(c) for c in langs], [text(c) for c in ("aa", "bb", "cc") * 5]
    p = langid.KernelParams(bits=22, landmarks=landmarks)
    model = langid.solve(np.packbits(langid._rows(train, p) > 0, axis=1), langs, p)
    names, n = sorted(parts), len(train)
    assert model.languages == names
    marks = [grams(train[k], p.max_n) for k in np.linspace(0, n - 1, min(n, landmarks)).astype(int)]
    own = kernel([grams(t, p.max_n) for t in train], marks)
    counts = Counter(langs)
    got_langs, got_scores = langid.judge(asked, model, p)
    values = []
    for c in names:
        y = np.array([1.0 if x == c else -1.0 for x in langs])
        b = np.diag([n / len(names) / counts[x] for x in langs])
        left = own.T @ b @ own + p.ridge * n * kernel(marks, marks) + 1e-6 * n * np.eye(len(marks))
        alpha = np.linalg.lstsq(left, own.T @ b @ (y - y.mean()), rcond=None)[0]
        values.append(kernel([grams(t, p.max_n) for t in asked], marks) @ alpha + y.mean())
    for k, row in enumerate(np.array(values).T):
        e = np.exp(p.sharpness * (row - row.max()))
        assert got_langs[k] == names[int(row.argmax())]
        assert abs(got_scores[k] - e.max() / e.sum()) < 0.01


def test_presence_counts_each_gram_once_and_whole_texts():
    p = langid.KernelParams(bits=22)
    for t in ("abc abc", "Ünï, códe 12 x", "a", "?!", "word " * 150_000 + "zzzy"):
        assert abs(int(langid._rows([t], p).sum()) - len(grams(t, p.max_n))) <= 1


def ftrl(rows, labels, p):
    """Per-coordinate updates of the regularised leader, one dict for each state."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    order = np.random.default_rng(5)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            w = {i: weight(i) for i in rows[k]}
            error = 1 / (1 + math.exp(-sum(w[i] * x for i, x in rows[k].items()))) - labels[k]
            for i, x in rows[k].items():
                g = error * x
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_against_dicts():
    rng = random.Random(8)
    p = quality.FtrlParams(bits=12)
    texts = [None, b"", b" \n"] + [" ".join(rng.choices("Alpha beta GAMMA 12 BUY!! | delta".split(), k=rng.randrange(1, 30))).encode() for _ in range(80)]
    labels = np.array([rng.randrange(2) for _ in texts])
    rows = []
    for t in texts:
        buckets = quality.features([t], p.bits)[0].tolist()
        rows.append({**{b: quality.SCALE * c / len(buckets) for b, c in Counter(buckets).items()}, 1 << p.bits: 1.0})
    want, got = ftrl(rows, labels, p), quality.train(texts, labels, p)
    assert len(got) == (1 << p.bits) + 1 and all(abs(got[i] - w) < 1e-9 for i, w in want.items())
    assert set(np.flatnonzero(got)) <= set(want)
    margins = quality.margins(texts, got[:-1], got[-1])
    assert all(abs(m - sum(got[i] * x for i, x in r.items())) < 1e-9 for m, r in zip(margins, rows))


def test_features_are_the_same_alone_and_together():
    texts = [b"one two two", None, b"", b"THREE 4!", b"one"]
    buckets, counts = quality.features(texts, 14)
    assert counts.tolist() == [len(quality.features([t], 14)[0]) for t in texts] == [18, 0, 0, 12, 6]
    assert buckets.tolist() == [b for t in texts for b in quality.features([t], 14)[0].tolist()]
