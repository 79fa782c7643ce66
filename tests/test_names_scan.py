"""Few names: texts are gone through once where they are read, and no row is made for a word or a window."""

import random
from difflib import SequenceMatcher

import pytest
from wardline.operators import names


def _near(w, x, ratio):
    return SequenceMatcher(None, w, x).ratio() >= ratio


def _frames(spark, texts, known):
    return spark.createDataFrame(texts, "i int, t array<string>"), spark.createDataFrame([(x,) for x in known], "name string")


def test_no_row_for_a_word_or_a_window(spark):
    t, d = _frames(spark, [(1, ["ann", "lee"])], ["ann lee", "kim"])
    for df in (names.substring_hits(t, d, "i", "t"), names.part_hits(t, d, "i", "t"), names.fuzzy_hits(t, d, "i", "t")):
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("letters", "ratio"), [("abn'", 0.85), ("eéñ😀a", 0.8), ("ab", 0.6)])
def test_misspelt_names_as_by_trying_all(spark, letters, ratio, monkeypatch):
    monkeypatch.setattr(names, "SLICE_CHARS", 300)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 9)))
    known = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(20)}) + ["a" * 70, "ab" * 40 + " b", ""]
    texts = [(i, [word() for _ in range(rng.randint(0, 9))]) for i in range(300)] + [(300, ["a" * 66]), (301, ["ab" * 39, "b"]), (302, None), (303, [])]
    t, d = _frames(spark, texts, known + [None, known[0]])
    want = {i for i, w in texts if w and any(_near(" ".join(w[k:k + len(x.split(" "))]), x, ratio) for x in known if x for k in range(len(w) - len(x.split(" ")) + 1))}
    assert {300, 301} <= want and {r[0] for r in names.fuzzy_hits(t, d, "i", "t", ratio).collect()} == want


def test_names_are_texts_not_patterns(spark, monkeypatch):
    monkeypatch.setattr(names, "PATTERN_BYTES", 8)
    texts = [(1, ["a.b"]), (2, ["axb"]), (3, ["(x", "y)"]), (4, ["ñandú+"]), (5, ["q"]), (6, []), (7, None), (None, ["a.b"]), (1, ["a.b"])]
    t, d = _frames(spark, texts, ["a.b", "(x y)", "ndú+", None, "a.b", "(xx y)"])
    hits = lambda df: sorted([r[0] for r in df.collect()], key=str)
    assert hits(names.substring_hits(t, d, "i", "t")) == [1, 3, 4, None]
    assert hits(names.part_hits(t, d, "i", "t", 2)) == [1, 3, None]
    assert hits(names.substring_hits(t, d.filter("false"), "i", "t")) == []
