"""Retrieval: questions that differ only behind their keys are one task, and hot keys are looked up only where few tasks don't do."""

import pytest
from tests.test_differential import brute_retrieve
from wardline.operators import retrieve


def _frames(spark, qs, cs):
    q = spark.createDataFrame([(i, t, see is None, see or []) for i, t, see in qs], "question_id int, question string, sees_all boolean, units array<string>")
    return q, spark.createDataFrame(cs, "chunk_id string, unit string, content string")


@pytest.mark.parametrize(("hot", "asks", "few"), [(0, 0, 500_000), (2, 1, 500_000), (15, 3, 0), (0, 100, 0), (10_000, 0, 0)])
def test_hot_by_chunks_and_tasks(spark, hot, asks, few, monkeypatch):
    monkeypatch.setattr(retrieve, "BROADCAST_KEYS", few)
    words = ["alpha", "alphabet", "beta", "blood", "bloodless", "cat", "delta7", "glucose", "80001", "8000123"]
    cs = [(f"c{i:03d}", "AB"[i % 2] if i % 5 else None, " ".join(words[(i * j) % 10] for j in range(1, 2 + i % 6))) for i in range(120)]
    qs = [(i, " ".join(words[(i + 3 * j) % 10] for j in range(i % 5)), [None, ["A"], ["A", "B"], []][i % 4]) for i in range(60)]
    q, c = _frames(spark, qs, cs)
    got = {tuple(r) for r in retrieve.retrieve(q, c, hot_min=hot, hot_share=0.0, hot_asks=asks).select("question_id", "chunk_id", "score", "rank").collect()}
    assert got == brute_retrieve(qs, cs)


def test_numbers_with_equal_keys_are_one_task(spark, monkeypatch):
    """1,000 record numbers of ten prefixes are ten tasks; each used to be one and to meet all postings of its prefix."""
    cut, seen = retrieve.cut, {}

    def noted(df):
        out = cut(df)
        if "_same" in out.columns:
            seen["tasks"] = out.count()
        return out

    monkeypatch.setattr(retrieve, "cut", noted)
    numbers = [f"{80000 + i // 100}{i % 100:02d}" for i in range(1000)]
    q, c = _frames(spark, [(i, f"number {x}", None) for i, x in enumerate(numbers)], [(f"c{x}", None, f"number {x}.") for x in numbers])
    assert retrieve.retrieve(q, c).count() == 5000
    assert seen["tasks"] == 10
