"""Removed passages against a plain scan of all strings of 100 bytes."""

import random

import numpy as np
import pytest

from wardline.llm import op3_suffix as S


def brute(rows):
    """rows: (doc_id, text), in any order; the kept bytes of each, by its place."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, (rows[i][1] or "").encode()))
    seen, out = set(), {}
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (str(rows[i][0]), len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return sorted(out.values())


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 8)))
    make = lambda k: " ".join(word() for _ in range(k))
    passages = [make(r.randrange(15, 60)) for _ in range(6)]
    line = "a line of sixty bytes that stands in very many of the texts "
    texts = []
    for _ in range(n):
        t = "".join(r.choice([make(r.randrange(3, 40)), r.choice(passages), line, "ab" * r.randrange(80), "-" * r.randrange(150)]) for _ in range(r.randrange(1, 7)))
        texts.append(t if r.random() < 0.7 or not texts else r.choice(texts))
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (None, None), (None, texts[0]), (900, ""), (5, texts[5]), (5, texts[6]), (901, "x" * 99), (902, "x" * 100), (903, "x" * 400), (904, texts[3] + texts[4] * 3)]


@pytest.mark.parametrize(("seed", "hot_task", "hot"), [(1, 64, 1024), (2, 4, 1024), (3, 64, 3), (4, 2, 2)])
def test_removed_bytes_match_brute_force(spark, monkeypatch, seed, hot_task, hot):
    monkeypatch.setattr(S, "HOT_TASK", hot_task)
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SECTION", 700 if seed % 2 else 1 << 20)
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, bucket string").repartition(5)
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in S.removed(df).collect())
    want = brute(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert got == want


def test_empty_table(spark):
    assert S.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_previous_factors():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    data[1500:1800] = data[200:500]
    data[3000:3350] = 97
    starts = np.arange(len(data) - 99)
    seen, want = set(), []
    for s in starts:
        w = data[s : s + 100].tobytes()
        want.append(w in seen)
        seen.add(w)
    assert S.previous_factors(data, starts).tolist() == want
