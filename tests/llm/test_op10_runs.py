"""Insults with a blank put in and phrases of common words: the toxicity machine reads across blanks."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq

from test_op10_pipeline import planted
from wardline.llm import op10_toxic

PHRASE = ["the", "anre", "shti", "on"]


def fitted(rows):
    return op10_toxic._fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))


def test_split_words_of_labelled_texts_are_found():
    """Held-out toxic texts of sf0.1 with a blank put into every word of five letters or more."""
    at = "/root/testdata/sf0.1/{}.parquet".format
    texts = dict(zip(*[c.to_pylist() for c in pq.read_table(at("documents"), columns=["doc_id", "text"]).columns], strict=True))
    labels = dict(zip(*[c.to_pylist() for c in pq.read_table(at("labels"), columns=["doc_id", "toxic"]).columns], strict=True))
    rows = [(i, texts[i], y) for i, y in sorted(labels.items()) if y is not None and 0 < len(texts.get(i) or "") <= 8000]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model, r = fitted([x for x in rows if not held(x[0])][:600]), random.Random(1)
    split = lambda t: " ".join(w[:k] + " " + w[k:] if len(w) >= 5 and (k := r.randrange(2, len(w) - 1)) else w for w in t.split(" "))
    test = [x for x in rows if held(x[0])][:400]
    said = model.scores(model.margins([split(t) for _, t, _ in test])) >= 0.5
    y = np.array([y for *_, y in test]) == 1
    assert said[y].mean() > 0.7 and said[~y].mean() < 0.15, (said[y].mean(), said[~y].mean())


def test_phrases_of_common_words_are_found():
    r = random.Random(4)
    rows = []
    for i in range(600):
        w = [r.choice(["the", "anre", "shti", "on", "reon", "tish", "anan", "rere"]) for _ in range(30)]
        w = " ".join(w).replace("shti on", "shti re").split(" ")
        y = i % 3 == 0
        if y:
            w[10:10] = PHRASE
        rows.append((i, " ".join(w), int(y)))
    model = fitted(rows[:450])
    right = [(s >= 0.5) == y for s, (_, _, y) in zip(model.scores(model.margins([t for _, t, _ in rows[450:]])), rows[450:], strict=True)]
    assert np.mean(right) > 0.9, np.mean(right)


def test_a_text_scores_alike_alone_and_among_others():
    model = fitted(planted(200, 1))
    texts = [t for _, t, _ in planted(20, 6)] + ["", "a", "a b", "mo ron", "x" * 60 + " y"]
    assert np.array_equal(model.margins(texts), np.concatenate([model.margins([t]) for t in texts]))
