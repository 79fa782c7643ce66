"""Distributed operators against ten-line statements of the same rule, on random inputs."""

import hashlib
import json
import random
import re
from collections import deque
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline import fixed
from wardline.operators import chain, names, ratelimit, retrieve, vector


def misspell(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(s) + 1)
        if rng.random() < 0.5 and i < len(s):
            s[i:i + 1] = rng.choice(["", rng.choice("aeinrst")])
        else:
            s.insert(i, rng.choice("aeinrst"))
    return re.sub(r"[^a-z' ]", "", "".join(s))


def test_fuzzy_join_misses_nothing(spark):
    rng = random.Random(3)
    word = lambda lo, hi: "".join(rng.choice("aeinrstlmo") for _ in range(rng.randint(lo, hi)))
    nm = sorted({" ".join(word(2, 9) for _ in range(n)) for n in (1, 2, 2, 2, 3) for _ in range(12)})
    win = sorted({misspell(rng, rng.choice(nm)) for _ in range(1500)} | {word(2, 6) + " " + word(2, 6) for _ in range(200)})
    win = [w for w in win if w and w == " ".join(w.split())]
    want = {(w, n) for w in win for n in nm if len(w.split()) == len(n.split()) and SequenceMatcher(None, w, n).ratio() >= 0.85}
    df = spark.createDataFrame([(w, len(w.split())) for w in win], "window string, n int")
    got = {tuple(r) for r in names.similar_windows(df, spark.createDataFrame([(n,) for n in nm], "name string")).select("window", "name").collect()}
    assert got == want and len(want) > 200


def test_substring_hits(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab'") for _ in range(rng.randint(1, 4)))
    nm = sorted({" ".join(word() for _ in range(rng.choice([1, 2, 2, 3, 4]))) for _ in range(40)})
    texts = [[word() for _ in range(rng.randint(0, 7))] for _ in range(300)]
    for pick in (nm, [n for n in nm if len(n) > 6]):
        want = {i for i, t in enumerate(texts) if any(n in " ".join(t) for n in pick)}
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t array<string>")
        assert {r[0] for r in names.substring_hits(df, spark.createDataFrame([(n,) for n in pick], "name string"), "i", "t").collect()} == want


def brute_retrieve(qs, cs, k=5):
    toks = lambda s: set(re.findall(r"[a-z0-9]+", s.lower()))
    out = set()
    for qid, text, see in qs:
        q = {fixed.SYNONYMS.get(t, t) for t in toks(text) if t not in fixed.STOPWORDS}
        scored = []
        for cid, unit, content in cs:
            if see is not None and unit not in see:
                continue
            c = toks(content)
            s = sum(1 for t in q if t in c or len(t) >= 5 and any(x[:5] == t[:5] for x in c if len(x) >= 5))
            if s:
                scored.append((-s, cid))
        best = min((s for s, _ in scored), default=0)
        out |= {(qid, cid, -s, i + 1) for i, (s, cid) in enumerate(sorted(x for x in scored if x[0] == best)[:k])}
    return out


@pytest.mark.parametrize("hot", [0, 2, 15, 10_000])
def test_retrieve_whatever_counts_as_hot(spark, hot):
    rng = random.Random(5)
    vocab = ["alpha", "alphabet", "beta", "blood", "bloodless", "cat", "dog", "delta7", "glucose", "sugar", "inpatient", "admitted", "the", "x1", "y2", "z3"] + [f"rare{i}" for i in range(30)]
    weights = [8] * 16 + [1] * 30
    cs = [(f"c{i:03d}", rng.choice(["A", "B", None]), " ".join(rng.choices(vocab, weights, k=rng.randint(1, 7)))) for i in range(150)]
    qs = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(0, 6))), rng.choice([None, ["A"], ["A", "B"], []])) for i in range(80)]
    q = spark.createDataFrame([(i, t, see is None, see or []) for i, t, see in qs], "question_id int, question string, sees_all boolean, units array<string>")
    c = spark.createDataFrame(cs, "chunk_id string, unit string, content string")
    got = {tuple(r) for r in retrieve.retrieve(q, c, hot_min=hot, hot_share=0.0).select("question_id", "chunk_id", "score", "rank").collect()}
    assert got == brute_retrieve(qs, cs)


@pytest.mark.parametrize("limit,window", [(1, 10), (3, 10), (5, 3)])
def test_rate_limit(spark, limit, window):
    rng = random.Random(limit)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c"]), 1_700_000_000 + rng.choice([rng.randint(0, 60), rng.randint(0, 2000)])) for i in range(800)]
    hits, want = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        q = hits.setdefault(k, deque())
        while q and t - q[0] >= window:
            q.popleft()
        want[i] = len(q) < limit
        if want[i]:
            q.append(t)
    df = spark.createDataFrame(rows, "id int, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for n in (1, 7):
        got = {r.id: r.admitted for r in ratelimit.rate_limit(df.repartition(n), "k", "ts", "id", limit, window).collect()}
        assert got == want
    assert not all(want.values())


def links(n=6):
    rows, prev = [], None
    for i in range(1, n + 1):
        r = {"event_id": f"e{i}", "event_time": f"2026-09-18T20:0{i}:00.000Z", "user_email": "a@x.org", "status": "ok", "path": "phi", "intent": "é\"\\", "model": "m",
             "model_version": "1", "chunk_ids": f"enc-{i}", "flags": None, "question": None, "answer": ""}
        h = hashlib.sha256(((prev or "") + "|" + json.dumps([r[f] for f in fixed.CHAIN_FIELDS], separators=(",", ":"), ensure_ascii=False)).encode()).hexdigest()
        rows.append({**r, "seq": i, "prev_hash": prev, "row_hash": h})
        prev = h
    return rows


SCHEMA = ", ".join(f"{f} string" for f in fixed.CHAIN_FIELDS)


def problems(spark, rows, bucket=100_000):
    df = spark.createDataFrame(rows, SCHEMA + ", seq long, prev_hash string, row_hash string")
    return {(r.seq, r.problem) for r in chain.verify_chain(df, bucket_rows=bucket).collect()}


def test_chain_extends_and_verifies(spark):
    want = links()
    df = spark.createDataFrame([{k: r[k] for k in fixed.CHAIN_FIELDS} for r in want], SCHEMA)
    got = [r.asDict() for r in chain.chain(df, ["event_id"]).orderBy("seq").collect()]
    assert got == want
    first = chain.chain(df.filter("event_id <= 'e2'"), ["event_id"])
    rest = chain.chain(df.filter("event_id > 'e2'"), ["event_id"], last=first)
    assert [r.row_hash for r in rest.orderBy("seq").collect()] == [r["row_hash"] for r in want[2:]]
    assert problems(spark, got) == set()


@pytest.mark.parametrize("bucket", [1, 2, 3, 100])
def test_chain_damage(spark, bucket):
    edit = links()
    edit[1]["status"] = "blocked"
    assert problems(spark, edit, bucket) == {(2, "edited")}
    gone = links()
    del gone[2]
    assert problems(spark, gone, bucket) == {(4, "gap"), (4, "prev_hash")}
    assert problems(spark, links()[:-1], bucket) == set()           # a cut tail cannot be seen
    swap = links()
    swap[1]["seq"], swap[2]["seq"] = 3, 2
    assert problems(spark, swap, bucket) == {(2, "prev_hash"), (3, "prev_hash"), (4, "prev_hash")}


def test_seal(spark):
    df = spark.createDataFrame([{k: r[k] for k in fixed.CHAIN_FIELDS} for r in links()], SCHEMA).withColumn("day", F.col("event_time").substr(1, 16))
    c = chain.chain(df, ["event_id"], ["user_email", "day"])
    s = chain.seal(c, ["user_email", "day"], ["user_email"])
    key = ["user_email", "day", "rows_in_chain", "head_hash"]
    assert s.count() == 6 and chain.verify_chain(s, ["user_email"], key).count() == 0
    assert chain.verify_chain(s.filter("seq <> 3"), ["user_email"], key).count() == 2


@pytest.mark.parametrize("scope", [None, "side"])
def test_vectors_small_and_blocked(spark, scope):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 8)).astype("float32")
    base[7] = base[3]
    base[50] = 0
    side = ["x" if i % 3 else "y" for i in range(120)]
    df = spark.createDataFrame([(i, base[i].tolist(), side[i]) for i in range(120)], "vec_id int, embedding array<float>, side string").repartition(5)
    q = df.filter("vec_id < 30").withColumnRenamed("vec_id", "query_id")
    unit = base / np.where(np.linalg.norm(base, axis=1, keepdims=True) == 0, 1, np.linalg.norm(base, axis=1, keepdims=True))
    want = set()
    for i in range(30):
        s = unit.astype("float64") @ unit[i].astype("float64")
        ids = [j for j in range(120) if scope is None or side[j] == side[i]]
        want |= {(i, j, r + 1) for r, j in enumerate(sorted(ids, key=lambda j: (-round(s[j], 12), j))[:5])}
    saved = vector.GROUP_ROWS, vector.BLOCK_QUERIES
    vector.GROUP_ROWS, vector.BLOCK_QUERIES = 25, 7
    try:
        for limit in (1 << 20, 1):
            got = {tuple(r) for r in vector.vector_topk(q, df, scope=scope, query_bytes=limit).filter("query_id <> 50").select("query_id", "vec_id", "rank").collect()}
            assert got == want
    finally:
        vector.GROUP_ROWS, vector.BLOCK_QUERIES = saved


def test_vectors_of_every_dimension_are_answered(spark):
    rows = [(i, [float(i), 1.0]) for i in range(4)] + [(10 + i, [1.0, float(i), 2.0]) for i in range(4)] + [(20, []), (21, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = df.withColumnRenamed("vec_id", "query_id")
    for limit in (1 << 20, 0):
        got = {(r.query_id, r.vec_id) for r in vector.vector_topk(q, df, k=1, query_bytes=limit).collect()}
        assert got == {(i, i) for i in [*range(4), *range(10, 14)]}


def test_equal_vectors_tie_by_id_in_any_layout(spark):
    import numpy as np

    v = np.random.default_rng(1).random((6, 17)).tolist()
    df = spark.createDataFrame([(i, v[i % 6]) for i in range(90)], "vec_id long, embedding array<double>")
    q = df.filter("vec_id < 6").withColumnRenamed("vec_id", "query_id")
    want = {(i, i + 6 * j, j + 1) for i in range(6) for j in range(5)}
    for parts, limit in ((1, 1 << 20), (50, 1 << 20), (7, 0)):
        got = {tuple(r) for r in vector.vector_topk(q, df.repartition(parts), query_bytes=limit).select("query_id", "vec_id", "rank").collect()}
        assert got == want


def test_requests_without_time_or_key(spark):
    rows = [(i, None, None) for i in range(3)] + [(10 + i, None, "2024-01-01 00:00:00") for i in range(2)] + [(20 + i, "", "2024-01-01 00:00:00") for i in range(2)]
    df = spark.createDataFrame(rows, "n long, k string, t string").withColumn("t", F.to_timestamp("t"))
    got = {r.n for r in ratelimit.rate_limit(df, "k", "t", "n", limit=1).filter("admitted").collect()}
    assert got == {10, 20}


def test_rows_without_a_number_are_reported_and_accuse_no_other(spark):
    df = spark.createDataFrame([(i, f"e{i}") for i in range(5)], "n long, event_id string")
    c = chain.chain(df, ["n"], fields=["event_id"])
    forged = c.unionByName(c.filter("n = 2").withColumn("seq", F.lit(None).cast("long")))
    assert [(r.seq, r.problem) for r in chain.verify_chain(forged, fields=["event_id"]).collect()] == [(None, "no_seq")]


def test_low_ratios_reach_long_windows():
    from difflib import SequenceMatcher

    _, windows = names.blocking_layout([(1, 4)], 0.5)
    assert max(w[1] for w in windows) == 12 and SequenceMatcher(None, "abcd" + "x" * 8, "abcd").ratio() == 0.5
