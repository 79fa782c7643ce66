"""The plain vector search on one small file: spread over the cores, scope by scope, block by block."""

import numpy as np
import pytest

from wardline.operators import vector


@pytest.mark.parametrize("scope", [None, "grp"])
def test_one_file_is_spread_and_blocks_lose_no_row(spark, tmp_path, monkeypatch, scope):
    monkeypatch.setattr(vector, "ROWS", 8, raising=False)
    monkeypatch.setattr(vector, "TILE", 16)
    r = np.random.default_rng(1)
    v = r.normal(size=(120, 4)).astype("float32")
    v[60:90] = v[5]                                             # ties across blocks
    v[100] = 0
    rows = [(i, [float(y) for y in x], [None, "a", "b"][i % 3]) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, grp string").coalesce(1).write.parquet(f"{tmp_path}/base")
    base = spark.read.parquet(f"{tmp_path}/base")
    out = vector.vector_topk(base.withColumnRenamed("vec_id", "query_id"), base, scope=scope)
    assert "RoundRobinPartitioning" in out._jdf.queryExecution().executedPlan().toString()
    norm = np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    u = np.divide(v, norm, out=np.zeros(v.shape), where=norm > 0)
    s = np.round(u @ u.T, vector.DECIMALS)
    want = set()
    for q in range(len(v)):
        mine = [i for i in range(len(v)) if scope is None or rows[i][2] == rows[q][2]]
        want |= {(q, i, n) for n, i in enumerate(sorted(mine, key=lambda i: (-s[q, i], i))[:5], 1)}
    got = [(x.query_id, x.vec_id, x["rank"]) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want
