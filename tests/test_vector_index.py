"""The coarse index: recall of its probes, exactness of what it certifies, every awkward vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import vector, vector_index

SCHEMA = "vec_id long, embedding array<float>, grp string"


def rows(n=1500, dim=16, groups=30, seed=3):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(groups, dim))
    v = mid[r.integers(groups, size=n)] + 0.4 * r.normal(size=(n, dim))
    out = [(i, [float(y) for y in x], "ab"[i % 2]) for i, x in enumerate(v)]
    out += [(n + i, out[0][1], "a") for i in range(40)]                                    # ties
    out += [(n + 50, [0.0] * dim, "a"), (n + 51, [0.0] * dim, "b"), (n + 52, None, "a"), (n + 53, [], "a"), (n + 54, [1.0, 2.0], "a"), (n + 55, out[1][1], None), (n + 56, [-x for x in out[0][1]], "a")]
    return out


def as_sets(df, *more):
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 7), *[r[m] for m in more]) for r in df.collect()}


@pytest.mark.parametrize("scope", [None, "grp"])
def test_exact_mode_is_exact(spark, scope):
    base = spark.createDataFrame(rows(), SCHEMA)
    q = base.filter("vec_id % 7 = 0 OR vec_id >= 1500").withColumnRenamed("vec_id", "query_id").select("query_id", "embedding", "grp")
    index = vector_index.build(base, scope=scope)
    assert index.rows.count() == 1500 + 40 + 2 + 1 + 1 + 1                                 # all but the null and the empty one
    # the scope of null is one of its own in the index and none in the plain form
    if scope:
        q = q.filter("grp IS NOT NULL")
    want = as_sets(vector.vector_topk(q, base, scope=scope))
    for probes in (1, 5):
        got = vector_index.search(q, index, probes=probes, exact=True, scope=scope)
        assert as_sets(got) == want and got.filter("NOT certified").count() == 0


def test_probes_have_recall_and_certify_only_what_is_exact(spark):
    base = spark.createDataFrame(rows(), SCHEMA)
    q = base.filter("vec_id < 1500 AND vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.build(base)
    want = as_sets(vector.vector_topk(q, base))
    got = vector_index.search(q, index, probes=8).cache()
    assert len(as_sets(got) & want) >= 0.95 * len(want)
    assert as_sets(got.filter("certified")) <= want and got.filter("certified").count() > 0


def test_cells_are_dealt_out_and_bounded(spark, monkeypatch):
    base = spark.createDataFrame(rows(600), SCHEMA)
    q = base.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = as_sets(vector.vector_topk(q, base))
    monkeypatch.setattr(vector_index, "CHUNK", 16)
    monkeypatch.setattr(vector_index, "BLOCK", 8)
    assert as_sets(vector_index.search(q, vector_index.build(base), probes=3, exact=True)) == want
    monkeypatch.setattr(vector_index, "MOST_VALUES", 10)                                   # no room for centres: one cell a scope
    index = vector_index.build(base)
    assert index.cells.filter("_v IS NOT NULL").count() == 0
    assert as_sets(vector_index.search(q, index, exact=True)) == want


def test_empty_sides(spark):
    base = spark.createDataFrame(rows(50), SCHEMA)
    none = base.limit(0)
    q = base.select(F.col("vec_id").alias("query_id"), "embedding")
    assert vector_index.search(q, vector_index.build(none), exact=True).count() == 0
    assert vector_index.search(q.limit(0), vector_index.build(base)).count() == 0


def test_a_vector_is_sent_once_a_group_and_not_once_a_cell(spark, monkeypatch):
    """Vectors without clusters leave nearly all cells open; hot cells are dealt over groups; no row is lost or told twice."""
    r = np.random.default_rng(7)
    v = [[float(y) for y in x] for x in r.normal(size=(600, 12))]
    v += [v[3]] * 150 + [[-y for y in v[4]]]
    base = spark.createDataFrame([(i, x, "ab"[i % 2]) for i, x in enumerate(v)], SCHEMA)
    q = base.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "grp")
    sent = []
    grouped = type(q).groupBy

    def seen(df, *by):
        if "_q" in df.columns and by[:2] == ("_s", "_d") and len(by) > 3:
            sent.append(df.count() / 251)
        return grouped(df, *by)

    for name, value in (("LEAST", 100), ("GROUPS", 4), ("MOST", 200), ("SLAB", 64), ("BLOCK", 50), ("CHUNK", 40)):
        monkeypatch.setattr(vector_index, name, value, raising=False)
    for scope in (None, "grp"):
        want = as_sets(vector.vector_topk(q, base, scope=scope))
        index = vector_index.build(base, scope=scope)
        with monkeypatch.context() as m:
            m.setattr(type(q), "groupBy", seen)
            got = vector_index.search(q, index, probes=2, exact=True, scope=scope)
        rows = got.collect()
        assert len(rows) == 251 * 5 and as_sets(got) == want and all(x.certified for x in rows)
    assert sent and max(sent) < 8               # two cells first, in up to six chunks, then four groups at most; before: nearly all of 28 cells


def sent_by(spark, monkeypatch, queries, index, **how):
    """The result, and how many queries and rows were sent: for the first cells, then for the rest."""
    kind, sent = type(spark.range(1)), []
    grouped = kind.groupBy

    def seen(df, *by):
        if by[:2] == ("_s", "_d") and "_b" in by:
            sent.append(df.count())
        return grouped(df, *by)

    with monkeypatch.context() as m:
        m.setattr(kind, "groupBy", seen)
        got = vector_index.search(queries, index, probes=2, exact=True, **how)
    assert len(sent) == 4
    return as_sets(got), sent


@pytest.mark.parametrize("scope", [None, "grp"])
def test_what_is_sent_grows_no_faster_than_the_input(spark, monkeypatch, scope):
    """Four times the vectors, all cells open: as many copies of a vector as before, in two scopes half as many as in one."""
    monkeypatch.setattr(vector_index, "LEAST", 64)
    copies = []
    for n in (600, 2400):
        v = np.random.default_rng(n).normal(size=(n, 24))
        base = spark.createDataFrame([(i, [float(y) for y in x], "ab"[i % 2]) for i, x in enumerate(v)], SCHEMA)
        q = base.select(F.col("vec_id").alias("query_id"), "embedding", "grp")
        got, sent = sent_by(spark, monkeypatch, q, vector_index.build(base, scope=scope), scope=scope)
        assert got == as_sets(vector.vector_topk(q, base, scope=scope))
        copies.append(sum(sent) / n)
    assert copies[1] <= 1.1 * copies[0] and max(copies) <= 3 + (8 if scope else 16)


@pytest.mark.parametrize("n, total, dim, parts", [(1, 1, 64, 1), (500, 1023, 64, 1), (5128, 10_256, 64, 4), (300_000, 600_000, 64, 4), (600_000, 600_000, 64, 8),
                                                  (4 << 20, 4 << 20, 64, 32), (600_000, 600_000, 1024, 74), (100, 600_000, 64, 1)])
def test_parts_are_a_fixed_number_unless_they_outgrow_a_task(n, total, dim, parts):
    assert vector_index._shares(n, total, dim) == parts


def test_a_hot_cell_is_sent_once_to_a_few_thousand_queries(spark, monkeypatch):
    """Equal vectors fill one cell, which all of their queries ask for first."""
    v = np.random.default_rng(2).normal(size=(200, 8))
    base = spark.createDataFrame([(i, [float(y) for y in v[i if i < 200 else 0]], "a") for i in range(2700)], SCHEMA)
    q = base.select(F.col("vec_id").alias("query_id"), "embedding")
    got, sent = sent_by(spark, monkeypatch, q, vector_index.build(base))
    assert got == as_sets(vector.vector_topk(q, base)) and len(got) == 2700 * 5
    assert sent[:2] == [2 * 2700, 2700]
