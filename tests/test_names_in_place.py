"""Few names: windows are tried where they are read. Many names: the joins by key give the same hits."""

import random

import pytest
from pyspark.sql import functions as F
from wardline.operators import names


@pytest.mark.parametrize("few", [2_000, 0])
def test_both_ways_give_the_same_hits(spark, few, monkeypatch):
    monkeypatch.setattr(names, "FEW_NAMES", few)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abn", k=rng.randint(1, 6)))
    nm = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(25)})
    texts = [(i, [word() for _ in range(rng.randint(0, 8))]) for i in range(200)]
    t = spark.createDataFrame(texts, "i int, t array<string>")
    d = spark.createDataFrame([(x,) for x in nm], "name string")
    assert {r[0] for r in names.substring_hits(t, d, "i", "t").collect()} == {i for i, w in texts if any(x in " ".join(w) for x in nm)}
    from difflib import SequenceMatcher
    near = lambda w, x: SequenceMatcher(None, w, x).ratio() >= 0.85
    want = {i for i, w in texts if any(near(" ".join(w[k:k + len(x.split())]), x) for x in nm for k in range(len(w) - len(x.split()) + 1))}
    assert {r[0] for r in names.fuzzy_hits(t, d, "i", "t").collect()} == want


def test_windows_of_texts_are_not_shuffled(spark):
    t = spark.createDataFrame([(1, ["ann", "lee"])], "i int, t array<string>")
    d = spark.createDataFrame([("ann lee",)], "name string")
    plan = names.substring_hits(t, d, "i", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(window" not in plan


def test_fewer_places_are_tried():
    assert len(names.blocking_layout([(2, 20)], 0.85)[1]) < 200     # 465 before: all moves within the edits, whatever the piece
