"""Exact top-k by vector similarity for a table of query vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline import fixed
from wardline.session import spread

QUERY_BYTES = 64 << 20      # query vectors up to this size travel to every task
TILE = 1024                 # ... and meet the rows of a batch this many at a time
ROWS = 2048                 # ... of which this many are scored at once
DECIMALS = 9                # scores are rounded, so that equal vectors tie whatever block they stand in
BLOCK_QUERIES = 4096        # beyond it they are joined in blocks of this many
GROUP_ROWS = 50_000         # ... against groups of about this many base rows
PAIR_TILE = 128             # ... this many queries at a time: 50 MB of scores


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    m = m.astype(np.float64)
    if metric == "cosine":
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return m


def _products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores of rows (down) and queries (across), laid out so that those of one query lie side by side."""
    return (queries @ rows.T).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> pd.DataFrame:
    """Per query (column) the rows that can be among its k best, boundary ties included. ``floor``: what its k-th best has already."""
    n = scores.shape[0]
    edge = floor
    if edge is None:
        edge = np.round(np.partition(scores, n - k, axis=0)[n - k], DECIMALS) if n > k else np.full(scores.shape[1], -np.inf)
    # only rows near the edge are rounded
    q, row = np.nonzero(scores.T >= (edge - 2 * 10.0**-DECIMALS)[:, None])
    score = np.round(scores[row, q], DECIMALS)
    keep = (score >= edge[q]) & np.isfinite(score)
    return pd.DataFrame({"q": q[keep], "id": ids[row[keep]], "score": score[keep]})


def _cut(df: pd.DataFrame, k: int) -> pd.DataFrame:
    return df.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable").groupby("q", sort=False).head(k)


def vector_topk(queries: DataFrame, base: DataFrame, k: int = fixed.TOP_K, metric: str = "cosine", query_id: str = "query_id",
                base_id: str = "vec_id", vec: str = "embedding", scope: str | None = None,
                query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, vec_id, score, rank``: the k most similar base rows of each query, ties by id. With ``scope`` a query
    only meets rows of its own scope, and always only rows of its own dimension. Zero vectors score 0; scores are rounded
    to DECIMALS.

    Every base row must be scored against every query, so the work is a blocked matrix product; what is kept small is the
    output: each task holds only its k best rows per query and only those are shuffled. The size of the query side is
    measured first: a small one is sent to the tasks (no shuffle of the base), a large one is joined block by block."""
    q = queries.select(F.col(query_id), F.col(vec).alias("_v"), *([F.col(scope).alias("_s")] if scope else [])).filter("_v is not null")
    b = base.select(F.col(base_id), F.col(vec).alias("_v"), *([F.col(scope).alias("_s")] if scope else [])).filter("_v is not null")
    q, b = (x.filter("size(_v) > 0").withColumn("_d", F.size("_v")) for x in (q, b))
    size = q.agg(F.coalesce(F.sum(F.col("_d") * 8), F.lit(0)).alias("n")).first()
    id_type = dict(b.dtypes)[base_id]
    qid_type = dict(q.dtypes)[query_id]
    out = f"{query_id} {qid_type}, {base_id} {id_type}, score double"
    part = (_broadcast_topk if size["n"] <= query_bytes else _blocked_topk)(q, b, k, metric, query_id, base_id, scope, out)
    top = W.partitionBy(query_id).orderBy(F.desc("score"), base_id)
    return part.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)


def _broadcast_topk(q, b, k, metric, query_id, base_id, scope, out):
    rows = q.toPandas()         # at most query_bytes, measured by the caller
    tiles = []                  # (dimension, ids, matrix, scope)
    # rows without a scope meet each other where null is a value and not NaN
    nulls = scope is not None and any(x is None for x in rows["_s"])
    for key, part in rows.groupby(["_d", "_s"] if scope else ["_d"], dropna=not nulls):
        for i in range(0, len(part), TILE):
            t = part.iloc[i : i + TILE]
            tiles.append((key[0], t[query_id].to_numpy(), _unit(np.stack(t["_v"].to_numpy()), metric), key[1] if scope and not pd.isna(key[1]) else None))

    def score(batches):
        kept, floor = [None] * len(tiles), [None] * len(tiles)
        for batch in batches:
            dims = batch.column("_d").to_numpy()
            scopes = batch.column("_s").to_pandas() if scope else None
            for d, s in dict.fromkeys((d, s) for d, _, _, s in tiles):
                mine = dims == d
                if scope:
                    mine = mine & (scopes.isna() if s is None else scopes == s).to_numpy(dtype=bool)
                part = batch.filter(pa.array(mine))
                m = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d), metric)
                ids = part.column(0).to_pandas().to_numpy()
                for r in range(0, len(m), ROWS):
                    for i, (qd, qids, qm, qs) in enumerate(tiles):
                        if qd == d and qs == s:
                            new = _best(_products(m[r : r + ROWS], qm), ids[r : r + ROWS], k, floor[i])
                            if not len(new):
                                continue
                            kept[i] = _cut(new if kept[i] is None else pd.concat([kept[i], new], ignore_index=True), k)
                            if len(kept[i]) == k * len(qids):
                                floor[i] = kept[i]["score"].to_numpy()[k - 1 :: k]
        for (_, qids, _, _), best in zip(tiles, kept):
            if best is not None and len(best):
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    query_id: qids[best["q"].to_numpy()], base_id: best["id"].to_numpy(), "score": best["score"].to_numpy()}), preserve_index=False)

    return spread(b).mapInArrow(score, out)


def _blocked_topk(q, b, k, metric, query_id, base_id, scope, out):
    nq, nb = q.count(), b.count()
    blocks, groups = max(1, -(-nq // BLOCK_QUERIES)), max(1, -(-nb // GROUP_ROWS))
    keys = ["_g", "_b", "_d"] + (["_s"] if scope else [])
    q = q.withColumn("_b", F.pmod(F.xxhash64(query_id), F.lit(blocks))).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    b = b.withColumn("_g", F.pmod(F.xxhash64(base_id), F.lit(groups))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q, b = [x.withColumn("_g", F.col("_g").cast("int")).withColumn("_b", F.col("_b").cast("int")) for x in (q, b)]

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({query_id: [], base_id: [], "score": []})
        m, ids, out = _unit(np.stack(right["_v"].to_numpy()), metric), right[base_id].to_numpy(), []
        for i in range(0, len(left), PAIR_TILE):
            some = left.iloc[i : i + PAIR_TILE]
            best = _cut(_best(_products(m, _unit(np.stack(some["_v"].to_numpy()), metric)), ids, k), k)
            out.append(pd.DataFrame({query_id: some[query_id].to_numpy()[best["q"].to_numpy()], base_id: best["id"].to_numpy(), "score": best["score"].to_numpy()}))
        return pd.concat(out, ignore_index=True)

    return q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(pair, out)
