"""The kernel, the counts and the choice of units against plain statements of the same rules."""

import itertools
import random

import numpy as np

from wardline.llm import op10_toxic as M

PARTS = M.in_parts


def code(word):
    return np.array([M.BLANK if c == " " else ord(c) - 96 for c in word], np.uint8)


def naive(a, b):
    """Common subsequences of three letters, each weighted by DECAY to the power of the places it spans beyond three, in both words."""
    def triples(w):
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < M.SPAN and " " not in (w[i], w[j], w[k]):
                yield (w[i], w[j], w[k]), M.DECAY ** (k - i - 2)

    def norm(w):
        n = len(w.replace(" ", ""))
        return max(sum(M.DECAY ** (2 * (k - i - 2)) for i, j, k in itertools.combinations(range(n), 3) if k - i < M.SPAN), 1e-9) ** 0.5

    return sum(x * y for (s, x), (t, y) in itertools.product(triples(a), triples(b)) if s == t) / norm(a) / norm(b)


def test_features_are_the_kernel():
    r = random.Random(3)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(3, 12))) for _ in range(12)] + ["ab cab", "a bca cb", "abcabcabcabc"]
    phi = [M._explicit(code(w)) for w in words]
    for (a, x), (b, y) in itertools.product(zip(words, phi), repeat=2):
        assert abs(float(x @ y) - naive(a, b)) < 1e-4
        assert abs(M.features(code(a)[None, :], y)[0] - naive(a, b)) < 1e-4       # a landmark's weights give the kernel with it
    mono = np.array([naive("idiotic", w) for w in ("idiotic", "id iotic", "idixotic", "table")])
    assert (np.diff(mono) < 0).all() and mono[3] < 0.1                           # a blank or a letter put in costs something and breaks nothing


def plain_units(text):
    """Words of at most LONGEST letters and runs of 2 to RUN of them that fit into LONGEST places."""
    words = text.split()
    out = {tuple(code(w)) for w in words}
    for k in range(2, M.RUN + 1):
        for i in range(len(words) - k + 1):
            if len(run := " ".join(words[i : i + k])) <= M.LONGEST:
                out.add(tuple(code(run)))
    return out


def test_units_are_counted_once_a_text_over_all_blocks(monkeypatch):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdef") for _ in range(r.randrange(2, 9))) for _ in range(25)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randrange(1, 30))) for _ in range(40)]
    y = np.array([r.randrange(2) for _ in texts])
    for most in (50, 400_000):
        monkeypatch.setattr(M, "in_parts", lambda t, m=most: PARTS(t, m))
        u = M._Units(texts, y)
        seen = {}
        for b in u.blocks:
            for i, g in enumerate(b.groups):
                for j, w in enumerate(g):
                    seen[tuple(w)] = int(b.all[b.bounds[i] + j])
        assert len(seen) == u.n
        for label, count in ((1, u.pos), (0, u.neg)):
            want = {}
            for t, v in zip(texts, y):
                for x in plain_units(t) if v == label else ():
                    want[x] = want.get(x, 0) + 1
            assert {x: int(count[i]) for x, i in seen.items() if count[i]} == want
        assert {x for x, i in seen.items() if u.word[i]} == {tuple(code(w)) for t in texts for w in t.split()}


def test_svm_in_blocks_solves_the_whole():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    y = np.sign(x[:, 0] + 0.3 * rng.normal(size=300))
    w = M._svm(x, y, np.ones(300), block=7)
    assert np.allclose(w, M._svm(x, y, np.ones(300), block=1000), atol=1e-6)
    z = np.c_[x, np.ones(300)]
    loss = lambda w: (np.maximum(0, 1 - y * (z @ w)) ** 2).mean() + M.PENALTY * (w[:-1] @ w[:-1] + 1e-3 * w[-1] ** 2)
    assert all(loss(w) <= loss(w + 1e-3 * d) + 1e-12 for d in rng.normal(size=(50, 7)))
