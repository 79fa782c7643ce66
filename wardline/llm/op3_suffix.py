"""Repeated passages by longest-previous-factor arrays: of every byte string of LENGTH bytes that occurs again, the first copy stays.

A suffix array of the whole corpus doesn't fit anywhere, so suffixes that can match are brought together first. In each window of LENGTH
bytes the GRAM bytes with the smallest hash are its anchor. Equal windows have equal anchors at equal offsets, so they meet under the hash of
the anchor; the windows of one anchor follow one another, and together they are its context, some 130 bytes, one for every 40 bytes of text.

1. Contexts are compared by hash. All but the first of equal contexts are repeats, decided within a task where they meet there (so a text
   that a third of all rows hold is sent once a task) and else in the anchor's bucket.
2. Where an anchor has several different contexts, the bytes of the first of each are gathered, and a suffix array (prefix doubling, to
   LENGTH bytes) is built over the windows of a bucket. Suffixes that agree on LENGTH bytes stand in text order there, so the previous
   smaller position of a suffix is its neighbour and the next smaller one lies beyond the run: the longest previous factor reaches LENGTH
   exactly if the neighbour before agrees that far.
3. An anchor with very many different contexts (a line in all sorts of surroundings) would make one bucket large. Its windows are dealt by
   their own 128-bit hash instead; all but the first of equal windows are repeats.

Texts go to the buckets of their documents only if something in them is flagged (a Bloom filter keeps the others in place); all records
travel packed by bucket.

Defined results: null and empty texts have no bytes and no spans; strings are judged on the input, by UTF-8 bytes, never across documents.
Documents stand in the order of doc_id, null ids last; rows that share an id, in the order of their texts. Contexts are taken as equal when
128 bits of their hashes agree. Extra columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bloom
from .common import keep, ship

ship(__name__)
LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM + 1
#: bytes of text hashed at a time; windows of longer texts are dealt over several sections
SECTION = 1 << 20
#: contexts of one anchor in one task, and in its bucket, beyond which its windows are dealt by their own hash
HOT_TASK, HOT = 64, 1024
BUCKET_BYTES = 4 << 20
RECORD = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("copy", "<i4"), ("a", "<i8"), ("n", "u1"), ("off", "u1")])
REPEAT, CONTEXT, WINDOW = 0, 1, 2
FLAG = np.dtype([("doc", "<i8"), ("copy", "<i4"), ("a", "<i8"), ("n", "<i4"), ("off", "u1"), ("kind", "u1")])
SENT = "bucket int, kind int, payload binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeded(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


def pack(records: np.ndarray) -> bytes:
    """Column after column, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(records[f]).tobytes() for f in records.dtype.names))


def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for f in kind.names:
        size = kind[f].itemsize * n
        out[f] = np.frombuffer(raw, kind[f], n, at)
        at += size
    return out


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hasher:
    """Hashes of grams and of any stretch of a buffer of up to SECTION and some bytes."""

    def __init__(self):
        n = SECTION + 2 * LENGTH + 8
        self.table, self.odd = [_seeded(256, s) for s in (1, 2, 3)], _seeded(8, 4) | np.uint64(1)
        self.up, self.down = zip(*(_powers(n, int(b)) for b in _seeded(2, 5) | np.uint64(1)), strict=True)

    def grams(self, buf: np.ndarray) -> np.ndarray:
        h, o = self.table[0][buf], self.odd
        for k, step in enumerate((1, 2, 4)):
            h = h[:-step] * o[k] + h[step:]
        sixteen = h[:-8] * o[3] + h[8:]
        n = len(buf) - GRAM + 1
        return mix(sixteen[:n] * o[4] + h[16 : 16 + n])

    def sums(self, buf: np.ndarray, which: int) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum(self.table[1 + which][buf] * self.up[which][: len(buf)], dtype=np.uint64)]

    def stretch(self, sums: np.ndarray, which: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[first]) * self.down[which][first])


def _hasher() -> Hasher:
    if "hasher" not in _STATE:
        _STATE["hasher"] = Hasher()
    return _STATE["hasher"]


_STATE: dict = {}


def _sections(texts: list[bytes]):
    """(bytes, [(text, offset in it, first in buffer, end in buffer)]) of up to SECTION bytes at a time; windows start in one section only."""
    parts, spans, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), SECTION):
            piece = t[at : at + SECTION + LENGTH - 1]
            if size + len(piece) > SECTION + LENGTH and parts:
                yield np.frombuffer(b"".join(parts), np.uint8), spans
                parts, spans, size = [], [], 0
            spans.append((i, at, size, size + len(piece)))
            parts.append(piece)
            size += len(piece)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), spans


def contexts(texts: list[bytes], doc: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """One record per anchor and section, in the order of ``texts``: a is the first window, n their number, off the anchor's offset in it."""
    hs, out = _hasher(), [np.empty(0, RECORD)]
    for buf, spans in _sections(texts):
        grams = hs.grams(buf)
        low = grams >> np.uint64(24) << np.uint64(24) | np.arange(len(grams), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-step], low[step:])
        p = (np.minimum(low[: len(low) - (REACH - 64)], low[REACH - 64 :]) & np.uint64(0xFFFFFF)).astype(np.int64)
        who, base, first, end = np.array(spans, np.int64).T
        valid = np.zeros(len(p) + 1, np.int8)
        np.add.at(valid, first, 1)
        np.add.at(valid, end - LENGTH + 1, -1)
        valid = np.cumsum(valid[:-1]) > 0
        start = valid & np.r_[True, (p[1:] != p[:-1]) | ~valid[:-1]]
        start[first] = True
        a = np.flatnonzero(start)
        span = np.searchsorted(first, a, "right") - 1
        stop = np.minimum(np.r_[a[1:], len(p)], (end - LENGTH + 1)[span])
        r = np.empty(len(a), RECORD)
        r["h"], r["doc"], r["copy"], r["a"], r["n"], r["off"] = grams[p[a]], doc[who[span]], copy[who[span]], a - first[span] + base[span], stop - a, p[a] - a
        r["c"] = mix(hs.stretch(hs.sums(buf, 0), 0, a, stop - 1 + LENGTH) ^ mix((stop - a).astype(np.uint64) << np.uint64(8) | r["off"]))
        out.append(r)
    return np.concatenate(out)


def _firsts(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether first of its h and c in it); records stand in text order."""
    order = np.argsort(r["h"] ^ mix(r["c"]), kind="stable")
    h, c = r["h"][order], r["c"][order]
    return order, np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(r) else np.zeros(0, bool)


def _flags(r: np.ndarray, kind: int) -> np.ndarray:
    out = np.empty(len(r), FLAG)
    for f in ("doc", "copy", "a", "n", "off"):
        out[f] = r[f]
    out["kind"] = kind
    return out


def _merged(f: np.ndarray) -> np.ndarray:
    """Repeats whose windows follow one another in one text, as one; f: flags of kind REPEAT."""
    if not len(f):
        return f
    f = f[np.lexsort((f["a"], f["copy"], f["doc"]))]
    new = np.r_[True, (f["doc"][1:] != f["doc"][:-1]) | (f["copy"][1:] != f["copy"][:-1]) | (f["a"][1:] != f["a"][:-1] + f["n"][:-1])]
    first = np.flatnonzero(new)
    out = f[first]
    out["n"] = np.add.reduceat(f["n"].astype(np.int64), first)
    return out


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(key), buckets) of 64-bit keys, as Spark has it."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    turn = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    h = np.full(len(key), 42 + 8, np.uint64) + p[4] ^ turn(key.view(np.uint64) * p[1], 31) * p[0]
    h = turn(h, 27) * p[0] + p[3]
    h = (h ^ h >> np.uint64(33)) * p[1]
    h = (h ^ h >> np.uint64(29)) * p[2]
    return (h ^ h >> np.uint64(32)).view(np.int64) % buckets


def _dealt(r: np.ndarray, key: np.ndarray, buckets: int, kind: int) -> list[tuple[int, int, bytes]]:
    b = _bucket(np.ascontiguousarray(key), buckets)
    order = np.argsort(b, kind="stable")
    edge = np.flatnonzero(np.diff(b[order], prepend=-1, append=-1)) if len(b) else []
    return [(int(b[order[i]]), kind, pack(r[order[i:j]])) for i, j in zip(edge[:-1], edge[1:], strict=True)] if len(b) else []


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], names=["bucket", "kind", "payload"])


#: kinds of packed rows beside the flags
ANCHORS, BYTES = 10, 11


def _scan(buckets: int):
    """Texts to records by anchor; what repeats in the batch is flagged at once."""

    def run(batches):
        for b in batches:
            doc, copy = b.column("doc").to_numpy(zero_copy_only=False), b.column("copy").to_numpy(zero_copy_only=False)
            order = np.lexsort((copy, doc))
            texts = b.column("text")
            r = contexts([(texts[int(i)].as_py() or "").encode("utf-8", "surrogatepass") for i in order], doc[order], copy[order])
            by, first = _firsts(r)
            flags = [_merged(_flags(r[by[~first]], REPEAT))]
            r = r[np.sort(by[first])]
            _, back, count = np.unique(r["h"], return_inverse=True, return_counts=True)
            hot = count[back] > HOT_TASK
            flags.append(_flags(r[hot], WINDOW))
            marks = np.zeros(len(np.unique(r["h"][hot])), RECORD)
            marks["h"] = np.unique(r["h"][hot])
            sent = np.concatenate([r[~hot], marks])
            rows = _dealt(sent, sent["h"], buckets, ANCHORS)
            for k, f in zip((REPEAT, WINDOW), flags, strict=True):
                rows += _dealt(f, f["doc"], buckets, k)
            yield _batch(rows)

    return run


def _judge(buckets: int):
    """The records of a bucket of anchors to flags by document; flags pass."""

    def run(table):
        kind, load = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        rows = [(int(b), k, p) for b, k, p in zip(table.column("bucket").to_pylist(), kind, load, strict=True) if k != ANCHORS]
        r = [unpack(p, RECORD) for k, p in zip(kind, load, strict=True) if k == ANCHORS]
        if r:
            r = np.concatenate(r)
            marked, r = np.unique(r["h"][r["n"] == 0]), r[r["n"] > 0]
            r = r[np.lexsort((r["a"], r["copy"], r["doc"]))]
            by, first = _firsts(r)
            out = [_flags(r[by[~first]], REPEAT)]
            r = r[by[first]]
            _, back, count = np.unique(r["h"], return_inverse=True, return_counts=True)
            hot = (count[back] > HOT) | np.isin(r["h"], marked)
            out += [_flags(r[hot], WINDOW), _flags(r[~hot & (count[back] > 1)], CONTEXT)]
            for k, f in zip((REPEAT, WINDOW, CONTEXT), out, strict=True):
                rows += _dealt(f, f["doc"], buckets, k)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _by_doc(flags: np.ndarray) -> dict:
    flags = flags[np.lexsort((flags["a"], flags["copy"], flags["doc"]))]
    edge = np.flatnonzero(np.r_[True, (flags["doc"][1:] != flags["doc"][:-1]) | (flags["copy"][1:] != flags["copy"][:-1])]) if len(flags) else []
    return {(int(f["doc"][0]), int(f["copy"][0])): f for f in np.split(flags, edge[1:])} if len(flags) else {}


def _fetch(buckets: int):
    """Documents and their flags to the bytes of contexts and to hashed windows."""

    def run(docs, table):
        own = _by_doc(np.concatenate([unpack(p, FLAG) for p in table.column("payload").to_pylist()] or [np.empty(0, FLAG)]))
        hs, wins, ctx = _hasher(), [np.empty(0, RECORD)], {}
        for i in range(docs.num_rows if own else 0):
            key = docs.column("doc")[i].as_py(), docs.column("copy")[i].as_py()
            if key not in own:
                continue
            raw = (docs.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass")
            for f in own[key]:
                a, n, off = int(f["a"]), int(f["n"]), int(f["off"])
                buf = np.frombuffer(raw, np.uint8, n + LENGTH - 1, a)
                if f["kind"] == CONTEXT:
                    h = hs.grams(buf[off : off + GRAM])[:1]
                    ctx.setdefault(int(_bucket(h, buckets)[0]), []).append((*key, a, n, buf.tobytes()))
                else:
                    w = np.zeros(n, RECORD)
                    s = np.arange(n)
                    w["doc"], w["copy"], w["a"], w["n"] = *key, a + s, 1
                    w["h"], w["c"] = (hs.stretch(hs.sums(buf, k), k, s, s + LENGTH) for k in (0, 1))
                    wins.append(w)
        w = np.concatenate(wins)
        w = w[np.lexsort((w["a"], w["copy"], w["doc"]))]
        by, first = _firsts(w)
        again = _merged(_flags(w[by[~first]], REPEAT))
        w = w[by[first]]
        rows = _dealt(w, w["h"], buckets, ANCHORS) + _dealt(again, again["doc"], buckets, REPEAT)
        kind = np.dtype([("doc", "<i8"), ("copy", "<i4"), ("a", "<i8"), ("n", "u1")])
        for b, got in ctx.items():
            head = np.array([x[:4] for x in got], kind).tobytes()
            rows.append((b, BYTES, zstandard.ZstdCompressor(level=1).compress(len(got).to_bytes(4, "little") + head + b"".join(x[4] for x in got))))
        return pa.Table.from_batches([_batch(rows)])

    return run


def suffix_ranks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each start, the rank of its LENGTH bytes among those of all starts: the order of a suffix array to that depth."""
    b = np.r_[data, np.zeros(LENGTH, np.uint8)].astype(np.uint64)
    n = len(data)
    rank = np.zeros(n + LENGTH - 8, np.uint64)
    for j in range(8):
        rank = rank << np.uint64(8) | b[j : j + len(rank)]
    size = 8
    while True:
        _, rank = np.unique(rank, return_inverse=True)
        rank = rank.astype(np.uint64)
        step = min(size, LENGTH - size)
        if size + step >= LENGTH:
            _, out = np.unique(rank[starts] << np.uint64(32) | rank[starts + step], return_inverse=True)
            return out
        rank = rank[:-step] << np.uint64(32) | rank[step:]
        size += step


def previous_factors(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each start (in text order), whether its longest previous factor reaches LENGTH bytes."""
    rank = suffix_ranks(data, starts)
    order = np.argsort(rank, kind="stable")  # the suffix array; within a run in text order
    out = np.zeros(len(starts), bool)
    out[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    return out


def _factors(buckets: int):
    """The contexts and windows of a bucket to repeats by document; flags pass."""

    def run(table):
        kinds, load = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        rows = [(int(b), k, p) for b, k, p in zip(table.column("bucket").to_pylist(), kinds, load, strict=True) if k == REPEAT]
        w = [unpack(p, RECORD) for k, p in zip(kinds, load, strict=True) if k == ANCHORS]
        out = []
        if w:
            w = np.concatenate(w)
            w = w[np.lexsort((w["a"], w["copy"], w["doc"]))]
            by, first = _firsts(w)
            out.append(_flags(w[by[~first]], REPEAT))
        kind = np.dtype([("doc", "<i8"), ("copy", "<i4"), ("a", "<i8"), ("n", "u1")])
        heads, texts = [], []
        for k, p in zip(kinds, load, strict=True):
            if k == BYTES:
                raw = zstandard.ZstdDecompressor().decompress(p)
                n = int.from_bytes(raw[:4], "little")
                heads.append(np.frombuffer(raw, kind, n, 4))
                texts.append(np.frombuffer(raw, np.uint8, offset=4 + n * kind.itemsize))
        if heads:
            head, data = np.concatenate(heads), np.concatenate(texts)
            size = head["n"].astype(np.int64) + LENGTH - 1
            first = np.cumsum(size) - size
            order = np.lexsort((head["a"], head["copy"], head["doc"]))
            n = head["n"][order].astype(np.int64)
            owner = np.repeat(order, n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            again = previous_factors(data, first[owner] + step)
            f = np.zeros(int(again.sum()), FLAG)
            f["doc"], f["copy"], f["a"], f["n"] = head["doc"][owner[again]], head["copy"][owner[again]], head["a"][owner[again]] + step[again], 1
            out.append(f)
        f = _merged(np.concatenate([_merged(x) for x in out] or [np.empty(0, FLAG)]))
        return pa.Table.from_batches([_batch(rows + _dealt(f, f["doc"], buckets, REPEAT))])

    return run


def _cut(docs, table):
    """Documents and their repeats to what is left."""
    own = _by_doc(np.concatenate([unpack(p, FLAG) for p in table.column("payload").to_pylist()] or [np.empty(0, FLAG)]))
    out = []
    for i in range(docs.num_rows):
        raw = (docs.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass")
        f = own.get((docs.column("doc")[i].as_py(), docs.column("copy")[i].as_py()))
        gone = np.zeros(len(raw) + 1, np.int64)
        if f is not None:
            np.add.at(gone, f["a"], 1)
            np.add.at(gone, f["a"] + f["n"] + LENGTH - 1, -1)
        gone = np.cumsum(gone[:-1]) > 0
        out.append((docs.column("doc_id")[i].as_py(), len(raw), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    cols = list(zip(*out, strict=True)) or [[]] * 5
    return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_bytes": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()), "n_spans": pa.array(cols[3], pa.int64()), "kept": pa.array(cols[4], pa.binary())})


def _numbered(docs: DataFrame) -> DataFrame:
    """doc, copy (a key of the row), doc_id, text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("doc", F.coalesce("doc_id", F.lit(2**63 - 1)))
    if d.groupBy("doc").count().where("count > 1").isEmpty():
        return d.withColumn("copy", F.lit(0))
    return keep(d.withColumn("copy", F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1))


def removed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    spark = docs.sparkSession
    d = _numbered(docs)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    whole = d.select("doc", "copy", "text")
    flags = keep(whole.mapInArrow(_scan(n), SENT).groupBy("bucket").applyInArrow(_judge(n), SENT))
    flags_of = lambda *kinds: flags.where(F.col("kind").isin(*kinds))

    def flagged(which: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The documents that flags may speak of, with their bucket, and all others."""
        ids = keep(which.select("payload").mapInArrow(_ids, "doc long").distinct())
        m = ids.count()
        seen = bloom.probe(d.withColumn("_h", F.xxhash64("doc")), bloom.members(ids.select(F.xxhash64("doc").alias("_h")), "_h", m), "_h", m, "_maybe")
        return seen.where("_maybe").select(F.pmod("_h", F.lit(n)).cast("int").alias("bucket"), "doc", "copy", "doc_id", "text"), seen.where("NOT _maybe")

    first = flags_of(CONTEXT, WINDOW)
    sent = flagged(first)[0].drop("doc_id").groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(_fetch(n), SENT)
    more = keep(sent.groupBy("bucket").applyInArrow(_factors(n), SENT))
    repeats = flags_of(REPEAT).unionByName(more)
    touched, others = flagged(repeats)
    cut = touched.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    none = F.lit(0).cast("long")
    return cut.unionByName(others.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept")))


def _ids(batches):
    for b in batches:
        got = [np.unique(unpack(p, FLAG)["doc"]) for p in b.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64))], names=["doc"])
