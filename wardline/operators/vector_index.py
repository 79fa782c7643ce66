"""A coarse index for vector search: cells around centres, probed by equi-joins, re-ranked exactly, with a bound that certifies results.

``build`` learns centres from a bounded sample and writes every base row down under its nearest centre, as a table (cell, id, vector). A
search looks at a query's nearest cells first. The distance to a cell's centre less the cell's radius is a lower bound for all of its
rows, so a query whose k-th best row lies nearer than the bounds of all cells it has not seen has its exact answer: it is certified. In
the exact mode the others go on to just those cells that their bound can't rule out, which certifies them too.

Unit vectors make distance and cosine the same order. Zero vectors, which score 0 against all, get an axis of their own (one for base
rows, one for queries), so that the bound holds for them as well."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline import fixed
from wardline.operators.vector import DECIMALS, _best, _cut, _products, _unit
from wardline.session import cut, small_lookup

MOST_CELLS = 4096           # centres of one scope and dimension
MOST_VALUES = 8 << 20       # centres travel to every task: at most this many numbers in all, for the largest scopes first
MOST_SCOPES = 256           # ... and for at most this many scopes; the rest of them are one cell each
SAMPLE_PER_CELL = 32        # ... learned from this many rows for each, chosen by a hash of the id
ROUNDS = 8
CHUNK, BLOCK = 8192, 1024   # a task takes at most this many rows of a cell and as many queries, and scores them against this many queries at once
SLACK = 1e-6                # for rounding, on every bound
LEAST, GROUPS, MOST = 1024, 8, 131_072      # the exact mode: cells are GROUPS groups and queries GROUPS blocks over all scopes, of LEAST to MOST rows each
MOST_HELD = 8 << 20         # ... and of at most this many numbers
SLAB = 2048                 # ... where a task scores this many rows at once


@dataclass
class Index:
    """``rows``: _s, _d, _c, id, vector, _k (chunk of the cell). ``cells``: _s, _d, _c, _n (rows), _r (radius), _v (centre)."""

    rows: DataFrame
    cells: DataFrame
    base_id: str


def _points(vectors: np.ndarray, base: bool) -> np.ndarray:
    """Unit vectors with two more places: one for zero vectors of the base, one for those of queries."""
    u = _unit(vectors, "cosine")
    more = np.zeros((len(u), 2))
    more[~u.any(1), 0 if base else 1] = 1
    return np.hstack([u, more])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _centres(points: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from ``n`` of the points; a centre left alone takes the point that is worst served."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    n = min(n, len(distinct))
    centres = distinct[rng.permutation(len(distinct))[:n]]
    for _ in range(ROUNDS):
        d = _distances(points, centres)
        near = d.argmin(1)
        count = np.bincount(near, minlength=n)
        new = np.zeros_like(centres)
        np.add.at(new, near, points)
        new[count > 0] /= count[count > 0][:, None]
        alone = np.flatnonzero(count == 0)
        new[alone] = points[np.argsort(-d.min(1), kind="stable")[: len(alone)]]
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * points @ centres.T
    return np.sqrt(np.maximum(square, 0))


def _with_keys(df: DataFrame, vec: str, scope: str | None) -> DataFrame:
    """``df`` with _s (scope as text) and _d (dimension), without rows that have no vector or whose vector holds a null."""
    s = F.coalesce(F.concat(F.lit("s"), F.col(scope).cast("string")), F.lit("")) if scope else F.lit("")
    return df.withColumns({"_s": s, "_d": F.size(vec)}).filter((F.col("_d") > 0) & ~F.exists(vec, lambda x: x.isNull()))


def build(base: DataFrame, base_id: str = "vec_id", vec: str = "embedding", scope: str | None = None, cells: int | None = None) -> Index:
    """The index of ``base``: for each scope and dimension about the root of its rows in cells, at most MOST_CELLS, or ``cells``.
    Every row is in it; only the centres come from a sample. A base with a hundred times the rows has ten times the cells of ten times
    the rows; past MOST_CELLS squared rows cells grow, and are dealt out in chunks."""
    b = _with_keys(base.select(base_id, vec, *([scope] if scope and scope != base_id else [])), vec, scope).select("_s", "_d", base_id, vec)
    spark, left, chosen = b.sparkSession, MOST_VALUES, []
    sizes = b.groupBy("_s", "_d").agg(F.count(F.lit(1)).alias("_n"))
    for r in sizes.orderBy(F.desc("_n"), "_s", "_d").limit(MOST_SCOPES).collect():
        m = min(cells or MOST_CELLS, cells or int(np.ceil(np.sqrt(r["_n"]))), left // (r["_d"] + 2))
        left -= m * (r["_d"] + 2)
        if m > 1:
            chosen.append((r["_s"], r["_d"], r["_n"], m))
    sizes = spark.createDataFrame(chosen, "_s string, _d int, _n long, _m int")
    share = F.least(F.lit(1.0), F.col("_m") * SAMPLE_PER_CELL / F.col("_n"))
    unit = F.pmod(F.xxhash64(base_id), F.lit(1 << 30)) / float(1 << 30)
    sample = b.join(F.broadcast(sizes), ["_s", "_d"]).filter(unit < share)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _centres(_points(np.stack(pdf.sort_values(base_id)[vec].to_numpy()), True), int(pdf["_m"].iloc[0]))
        return pd.DataFrame({"_s": pdf["_s"].iloc[0], "_d": pdf["_d"].iloc[0], "_c": np.arange(len(c), dtype="int32"), "_v": list(c)})

    # a group is a bounded sample: about SAMPLE_PER_CELL * MOST_CELLS rows
    centres = cut(sample.groupBy("_s", "_d").applyInPandas(learn, "_s string, _d int, _c int, _v array<double>"))
    sent = spark.sparkContext.broadcast(_by_key(centres))
    schema = f"_s string, _d int, {base_id} {dict(b.dtypes)[base_id]}, {vec} {dict(b.dtypes)[vec]}, _c int, _dist double"

    def assign(batches):
        for batch in batches:
            for key, part in _parts(batch):
                c, d = sent.value.get(key), None
                p = _points(_matrix(part.column(vec)), True)
                if c is not None:
                    d = _distances(p, c)
                near = np.zeros(len(p), "int32") if d is None else d.argmin(1).astype("int32")
                far = np.full(len(p), 2.0) if d is None else d.min(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near), pa.array(far)], names=[*part.schema.names, "_c", "_dist"])

    rows = cut(b.mapInArrow(assign, schema))
    # a scope without centres is one cell, which every query of it looks at
    found = rows.groupBy("_s", "_d", "_c").agg(F.count(F.lit(1)).alias("_n"), F.max("_dist").alias("_r"))
    cells_ = cut(found.join(centres, ["_s", "_d", "_c"], "left"))
    rows = rows.join(small_lookup(cells_.select("_s", "_d", "_c", "_n")), ["_s", "_d", "_c"]).withColumn("_k", F.pmod(F.xxhash64(base_id), F.ceil(F.col("_n") / CHUNK)).cast("int")).drop("_n", "_dist")
    return Index(cut(rows), cells_, base_id)


def _by_key(cells: DataFrame) -> dict:
    """The centres by scope and dimension, for broadcast; at most MOST_CELLS for each."""
    out: dict = {}
    for r in cells.select("_s", "_d", "_c", "_v").orderBy("_s", "_d", "_c").toLocalIterator():
        out.setdefault((r["_s"], r["_d"]), []).append(r["_v"])
    return {k: np.array(v) for k, v in out.items()}


def _parts(batch: pa.RecordBatch):
    """((scope, dimension), rows) of a batch."""
    keys = pd.DataFrame({"s": batch.column("_s").to_pandas(), "d": batch.column("_d").to_pandas()})
    for key, at in keys.groupby(["s", "d"]).indices.items():
        yield (key[0], int(key[1])), batch.take(pa.array(at))


def search(queries: DataFrame, index: Index, k: int = fixed.TOP_K, probes: int = 8, exact: bool = False, query_id: str = "query_id",
           vec: str = "embedding", scope: str | None = None) -> DataFrame:
    """``query_id, id, score, rank, certified``: the k most similar rows of each query, ties by id, from its ``probes`` nearest cells;
    ``certified`` where that is provably the exact answer. With ``exact`` every query goes on until it is."""
    stats: dict = {}
    for r in index.cells.filter("_v IS NOT NULL").select("_s", "_d", "_c", "_r", "_v", "_n").orderBy("_s", "_d", "_c").toLocalIterator():        # MOST_VALUES numbers at most
        stats.setdefault((r["_s"], r["_d"]), []).append((r["_c"], r["_r"], r["_v"], r["_n"]))
    total = sum(x[3] for v in stats.values() for x in v)
    sent = queries.sparkSession.sparkContext.broadcast({key: (*(np.array([x[i] for x in v]) for i in range(3)), *_dealt(np.array([x[3] for x in v]), total, key[1])) for key, v in stats.items()})
    q = _with_keys(queries.select(query_id, vec, *([scope] if scope and scope != query_id else [])), vec, scope)
    q = q.select("_s", "_d", query_id, F.col(vec).alias("_v"), F.monotonically_increasing_id().alias("_q"))
    fields = f"_s string, _d int, {query_id} {dict(q.dtypes)[query_id]}, _v {dict(q.dtypes)['_v']}, _q long, first array<int>"

    def plan(batches):
        """The first ``probes`` cells of each query, nearest first."""
        for batch in batches:
            for key, part in _parts(batch):
                known, n = sent.value.get(key), part.num_rows
                first = [[0]] * n if known is None else known[0][np.argsort(_distances(_points(_matrix(part.column("_v")), False), known[2]), axis=1, kind="stable")[:, :probes]].tolist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(first, pa.list_(pa.int32()))], names=[*part.schema.names, "first"])

    # a query's vector goes on beside its cells, so that no join has to bring them together again
    q = cut(q.mapInArrow(plan, fields))
    found = cut(_score(q.select("_s", "_d", "_q", "_v", F.explode("first").alias("_c")), index, k))
    worst = found.groupBy("_q").agg(F.min("score").alias("_w"), F.count(F.lit(1)).alias("_n"))
    # unit vectors: distance^2 = 2 - 2 score
    full = F.col("_n") >= k
    reach = F.when(full, F.sqrt(F.greatest(2 - 2 * F.col("_w"), F.lit(0.0))) + SLACK).otherwise(F.lit(float("inf")))
    left = q.join(worst, "_q", "left").select(*q.columns, F.coalesce(reach, F.lit(float("inf"))).alias("reach"), F.coalesce(F.when(full, F.col("_w")), F.lit(float("-inf"))).alias("floor"))

    def judge(batches):
        """The groups in which a query has cells that its bound can't rule out."""
        for batch in batches:
            for key, part in _parts(batch):
                groups, known = [[]] * part.num_rows, sent.value.get(key)
                if known is not None:
                    cell, radius, centre, g, n = known
                    groups = []
                    for row in _open(_matrix(part.column("_v")), part.column("first").to_pylist(), part.column("reach").to_numpy(), cell, radius, centre):
                        at = np.flatnonzero(row)
                        wide = at[n[at] > 1]
                        groups.append(np.unique(np.concatenate([g[at], *(g[i] + np.arange(n[i]) for i in wide)])).tolist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(groups, pa.list_(pa.int32()))], names=[*part.schema.names, "groups"])

    left = cut(left.mapInArrow(judge, f"{fields}, reach double, floor double, groups array<int>"))
    if exact:
        found = found.unionByName(_rest(left.filter(F.size("groups") > 0), index, k, sent))
    rank = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), index.base_id))
    top = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    sure = left.select("_q", query_id, (F.lit(exact) | (F.size("groups") == 0)).alias("certified"))
    return top.join(sure, "_q").select(query_id, index.base_id, "score", "rank", "certified")


def _shares(n: int, total: int, dim: int) -> int:
    """Into how many parts ``n`` of ``total`` rows are dealt: a fixed number in all scopes together, so that what is sent grows like the input,
    unless parts outgrow a task."""
    return max(round(n * min(GROUPS, total // LEAST) / total), -(-n // min(MOST, max(MOST_HELD // dim, 1))), 1)


def _dealt(sizes: np.ndarray, every: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each cell and over how many its chunks are dealt: one, unless the cell is larger than a group."""
    total = int(sizes.sum())
    parts = _shares(total, every, dim)
    many = np.clip(np.round(sizes * parts / total).astype(int), 1, parts)
    return np.minimum((np.cumsum(sizes) - sizes) * parts // total, parts - many), many


def _open(vectors: np.ndarray, first: list, reach: np.ndarray, cell: np.ndarray, radius: np.ndarray, centre: np.ndarray):
    """For each query which cells other than its ``first`` ones may hold rows within its ``reach``."""
    points = _points(vectors, False)
    for i in range(0, len(points), BLOCK):
        low = np.maximum(_distances(points[i : i + BLOCK], centre) - radius[None, :], 0) - SLACK
        may = low <= reach[i : i + BLOCK, None]
        for row, seen in zip(may, first[i : i + BLOCK]):
            yield row & ~np.isin(cell, seen)


def _rest(queries: DataFrame, index: Index, k: int, sent) -> DataFrame:
    """The rows of the open cells of ``queries`` that are among a query's k best. A group of cells meets a block of queries in one task, so a
    vector is sent once for each group with an open cell, not once a cell; which cells those are is told again where they meet."""
    base_id, spark = index.base_id, queries.sparkSession
    key = ["_s", "_d", "_g", "_b"]
    cells = [(s, d, int(c), int(g), int(n)) for (s, d), (cell, _, _, first, many) in sent.value.items() for c, g, n in zip(cell, first, many)]
    cells = spark.createDataFrame(cells, "_s string, _d int, _c int, _g0 int, _gn int")
    asked = queries.groupBy("_s", "_d").agg(F.count(F.lit(1)).alias("n")).collect()      # of scopes with centres: MOST_SCOPES at most
    total = sum(r["n"] for r in asked)
    blocks = spark.createDataFrame([(r["_s"], r["_d"], _shares(r["n"], total, r["_d"])) for r in asked], "_s string, _d int, _blocks int")
    ask = queries.join(F.broadcast(blocks), ["_s", "_d"]).withColumn("_b", F.pmod(F.xxhash64("_q"), F.col("_blocks")).cast("int"))
    ask = ask.select("_s", "_d", "_b", "_q", "_v", "first", "reach", "floor", F.explode("groups").alias("_g"))
    rows = index.rows.join(small_lookup(cells), ["_s", "_d", "_c"]).withColumn("_g", (F.col("_g0") + F.pmod("_k", "_gn")).cast("int"))
    met = ask.select("_s", "_d", "_g", F.col("_b").alias("_b")).distinct()
    rows = rows.join(small_lookup(met), ["_s", "_d", "_g"]).select(*key, "_c", base_id, F.col(_vec_of(index)).alias("_v"))

    def pair(at, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"_q": np.array([], "int64"), base_id: right[base_id].iloc[:0], "score": np.array([], "float64")})
        if left.empty or right.empty:
            return none
        cell, radius, centre, *_ = sent.value[at[0], int(at[1])]
        right = right.sort_values("_c", kind="stable")
        b, ids = _unit(np.stack(right["_v"].to_numpy()), "cosine"), right[base_id].to_numpy()
        here, of = np.unique(np.searchsorted(cell, right["_c"].to_numpy()), return_inverse=True)
        out = [none]
        for i in range(0, len(left), BLOCK):
            some = left.iloc[i : i + BLOCK]
            v, floor, kept = np.stack(some["_v"].to_numpy()), some["floor"].to_numpy().copy(), None
            u = _unit(v, "cosine")
            may = np.stack([*_open(v, some["first"].tolist(), some["reach"].to_numpy(), cell[here], radius[here], centre[here])])
            for r in range(0, len(b), SLAB):
                mine = of[r : r + SLAB]
                asks = np.flatnonzero(may[:, mine[0] : mine[-1] + 1].any(1))
                if not len(asks):
                    continue
                scores = _products(b[r : r + SLAB], u[asks])
                scores[~may[asks][:, mine].T] = -np.inf
                edge = floor[asks]
                new = np.flatnonzero(np.isneginf(edge))
                if len(new) and len(scores) > k:
                    edge[new] = np.round(np.partition(scores[:, new], len(scores) - k, axis=0)[len(scores) - k], DECIMALS)
                best = _best(scores, ids[r : r + SLAB], k, edge)
                if len(best):
                    best["q"] = asks[best["q"].to_numpy()]
                    kept = _cut(best if kept is None else pd.concat([kept, best], ignore_index=True), k)
                    last = kept.groupby("q")["score"].agg(["size", "min"])
                    last = last[last["size"] == k]
                    floor[last.index] = np.maximum(floor[last.index], last["min"])
            if kept is not None:
                out.append(pd.DataFrame({"_q": some["_q"].to_numpy()[kept["q"].to_numpy()], base_id: kept["id"].to_numpy(), "score": kept["score"].to_numpy()}))
        return pd.concat(out, ignore_index=True)

    return ask.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(pair, f"_q long, {base_id} {dict(index.rows.dtypes)[base_id]}, score double")


def _vec_of(index: Index) -> str:
    """The vector column of the index's rows."""
    return next(c for c in index.rows.columns if c not in ("_s", "_d", "_c", "_k", index.base_id))


def _score(ask: DataFrame, index: Index, k: int) -> DataFrame:
    """The k best rows of each query in the cells that it asks for (_s, _d, _q, _v, _c). Pairs are formed inside tasks only: chunks of a cell
    meet blocks of its queries, however many of either there are."""
    base_id = index.base_id
    cell, key = ["_s", "_d", "_c"], ["_s", "_d", "_c", "_k", "_b"]
    many = cut(ask.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_blocks")).join(index.cells.select(*cell, F.ceil(F.col("_n") / CHUNK).cast("int").alias("_chunks")), cell))
    few = small_lookup(many)
    ask = ask.join(few, cell).withColumn("_b", F.pmod(F.xxhash64("_q"), F.col("_blocks")).cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_blocks", "_chunks")
    rows = index.rows.join(few.drop("_chunks"), cell).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_q": [], base_id: [], "score": []})
        b, out = _unit(np.stack(right[index_vec].to_numpy()), "cosine"), []
        ids = right[base_id].to_numpy()
        for i in range(0, len(left), BLOCK):
            some = left.iloc[i : i + BLOCK]
            best = _cut(_best(_products(b, _unit(np.stack(some["_v"].to_numpy()), "cosine")), ids, k), k)
            out.append(pd.DataFrame({"_q": some["_q"].to_numpy()[best["q"].to_numpy()], base_id: best["id"].to_numpy(), "score": best["score"].to_numpy()}))
        return pd.concat(out, ignore_index=True)

    index_vec = _vec_of(index)
    got = ask.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(pair, f"_q long, {base_id} {dict(index.rows.dtypes)[base_id]}, score double")
    rank = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), base_id))
    return got.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
