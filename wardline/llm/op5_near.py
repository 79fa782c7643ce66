"""Near duplicates by fast similarity sketching, banding and exact verification.

The sketch: every shingle of a text is hashed into one of T bins per round, and a bin keeps the smallest value of the first round that
reaches it. After T rounds of random bins, round T + i puts every shingle into bin i, so that all coordinates are filled after 2 T rounds,
and after a few for texts with more shingles than bins. Unlike one hashing with T bins it leaves no bin to borrow, and the share of equal
coordinates is as closely concentrated about the similarity as with T independent hashes, for the price of about one pass over the set.

Bands of BAND coordinates make the candidates: two texts with a similarity of 0.8 share none of 40 bands of five with probability 1e-7.
Texts with equal sets are one node. Within a bucket, no pairs are listed: each node is held against a hub that is the same for most
buckets of a group, and where that leaves them apart against one drawn by bucket. Verified links join nodes into components. Only in buckets that then still hold several
components is the rest tried: the nodes outside the hub's component against all others, block by block inside the tasks, first by
sketch (4 bits a coordinate; a pair is passed over when fewer than CLOSE of 200 agree, which happens to a true link with probability below
1e-9), then exactly, until a link joins their components. So components are those of all links, no pairs are listed, and a bucket whose
nodes hang together costs linear time.

Defined results: null texts count as empty; texts without words have no shingles and are linked with nothing. Rows without an id share the
component of the texts they equal or, alone, have none and are kept. Rows with one id and several texts are one node linked by all of them.
The kept document of a component is the one with the smallest id; repeated rows of it all stay (drop exact copies first)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import attach, keep, ship, store

ship(__name__)
T, BAND, CLOSE = 200, 5, 128
BLOCK = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 40)) | np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    b = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    real = ~_BLANK[b]
    edge = np.diff(np.r_[False, real, False].astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, np.uint64)
    b, size = b[real], end - first
    start = np.cumsum(size) - size
    at = np.arange(len(b)) - np.repeat(start, size)
    return mix(np.add.reduceat((b.astype(np.uint64) + np.uint64(1)) * _multipliers(int(size.max()), 1)[at], start) ^ mix(size.astype(np.uint64)))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``k`` words; of the whole sequence, if shorter."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    m = _multipliers(max(k, len(w) if len(w) < k else k), 2)
    if len(w) < k:
        return mix(np.array([(w * m[: len(w)]).sum(dtype=np.uint64) ^ np.uint64(len(w))]))
    n = len(w) - k + 1
    return np.unique(mix(sum((w[i : i + n] * m[i] for i in range(k)), np.zeros(n, np.uint64))))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of T coordinates per set; none of the sets may be empty."""
    d = len(sets)
    out = np.full(d * T, np.iinfo(np.uint64).max, np.uint64)
    empty = np.ones(d * T, bool)
    h, owner = np.concatenate(sets), np.repeat(np.arange(d), [len(s) for s in sets])
    for r in range(2 * T):
        v = mix(h ^ _multipliers(1, 100 + r)[0])
        at = owner * T + ((v >> np.uint64(32)) * np.uint64(T) >> np.uint64(32)).astype(np.int64) if r < T else owner * T + (r - T)
        new = empty[at]
        at, v = at[new], mix(v[new])
        np.minimum.at(out, at, v)
        empty[at] = False
        left = empty.reshape(d, T).any(1)
        if not left.any():
            break
        if not left.all():
            still = left[owner]
            h, owner = h[still], owner[still]
    return out.reshape(d, T)


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, cls (hash of the set), bands, sig of every row."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                sets = [shingles(t, k) for t in part.column("text").to_pylist()]
                some = [s for s in sets if len(s)]
                cls, bands, sig = [b""] * len(sets), [None] * len(sets), [None] * len(sets)
                if some:
                    x = sketches(some)
                    m = _multipliers(BAND, 3)
                    key = mix((x.reshape(len(some), -1, BAND) * m).sum(2, dtype=np.uint64) ^ mix(np.arange(T // BAND, dtype=np.uint64)))
                    nib = (x & np.uint64(15)).astype(np.uint8)
                    nib = nib[:, ::2] | nib[:, 1::2] << 4
                    for j, at in enumerate(i2 for i2, s in enumerate(sets) if len(s)):
                        s = some[j]
                        cls[at] = int(mix(s).sum(dtype=np.uint64)).to_bytes(8, "little") + int(mix(s ^ np.uint64(77)).sum(dtype=np.uint64)).to_bytes(8, "little")
                        bands[at], sig[at] = key[j].view(np.int64), nib[j].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                                                 names=["doc_id", "n", "cls", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, cls binary, bands array<long>, sig binary")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return ((x & 15) == 0).sum(-1) + ((x >> 4) == 0).sum(-1)


def _near(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    s = nodes.select("node", "n", "sig")
    two = pairs.join(s.toDF("a", "na", "sa"), "a").join(s.toDF("b", "nb", "sb"), "b").where(f"100 * least(na, nb) >= {share} * greatest(na, nb)")

    def run(batches):
        for b in batches:
            if b.num_rows:
                sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(_agree(sa, sb) >= CLOSE))

    return two.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.r_[x, y]
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """node, set of the nodes in ``ids`` (distinct, a checkpoint); other texts stay where they are."""
    n = ids.count()
    passed = bloom.probe(docs.select(F.col("doc_id").cast("long").alias("node"), "text").withColumn("_h", F.xxhash64("node")), bloom.members(ids.withColumn("_h", F.xxhash64("node")), "_h", n), "_h", n, "_maybe")
    rows = passed.where("_maybe").select("node", "text").join(ids, "node", "left_semi")

    def to_sets(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingles(t, k).tobytes() for t in part.column("text").to_pylist()], pa.binary())], names=["node", "set"])

    return rows.mapInArrow(to_sets, "node long, set binary").distinct()


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, share: int) -> DataFrame:
    """The pairs that are links: 100 * intersection >= share * union of the full sets."""
    pairs = keep(_near(pairs, nodes, share))
    sets = keep(_sets(keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), docs, k))

    def verify(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                i = _shared(x, y)
                ok.append(100 * i >= share * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    two = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return keep(two.mapInArrow(verify, "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that ``links`` (a, b) reach from it. By contraction: in each round every node points to the neighbour
    that comes first in an order drawn anew for the round, if that comes before itself, and is merged with the one that its neighbour points
    to. As the order is drawn, a part of the nodes that doesn't depend on the shape vanishes in each round: chains and stars alike take a
    number of rounds that grows with the logarithm of their size."""
    edges = links.where("a <> b").select("a", "b").distinct()
    labels, turn = None, 0
    while True:
        turn += 1
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.min(place("b")).alias("m"))
        first = store(first.select("a", F.when(F.col("m") < place("a"), F.col("m.id")).otherwise(F.col("a")).alias("up")))
        if first.isEmpty():
            break
        to = store(first.join(first.select(F.col("a").alias("up"), F.col("up").alias("to")), "up").select("a", "to"))
        one = to.select(F.col("a").alias("label"), "to")
        labels = store(to.select(F.col("a").alias("node"), F.col("to").alias("label")) if labels is None else
                      labels.join(one, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        # plain joins with a checkpoint: adaptive execution splits the partition of a hub
        y = edges.join(to, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(to, "a").select("x", F.col("to").alias("y")).where("x <> y")
        edges = store(y.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, label long")
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return store(labels.join(least, "label").select("node", F.col("least").alias("label")))


def _meet(u: DataFrame, cols: list[str], run, schema: str) -> DataFrame:
    """Under each ``main``, every block of nodes outside the main component (x) with every block of such nodes and every block of the
    main component. A row for ``run`` is two blocks of up to about BLOCK nodes: main, same (one block twice), v1, v2."""
    sizes = keep(u.groupBy("main").agg(F.sum(F.col("x").cast("int")).alias("nx"), F.count(F.lit(1)).alias("size")).where("nx > 0"))
    u = attach(u, sizes, "main", "size", F.col("node")).where("nx IS NOT NULL")
    u = u.withColumns({"bx": F.ceil(F.col("nx") / BLOCK), "bm": F.ceil((F.col("size") - F.col("nx")) / BLOCK)})
    h = F.xxhash64("node")
    u = u.withColumn("block", F.when(F.col("x"), F.pmod(h, F.col("bx"))).otherwise(F.col("bx") + F.pmod(h, F.greatest("bm", F.lit(1)))))
    packed = keep(u.groupBy("main", "block", "bx", "bm").agg(F.collect_list(F.struct("node", "label", "n", *cols)).alias("v")))
    left = packed.where("block < bx").select("main", F.col("block").alias("i"), F.col("v").alias("v1"), F.explode(F.sequence("block", F.col("bx") + F.col("bm") - 1)).alias("block"))
    two = left.join(packed.select("main", "block", F.col("v").alias("v2")), ["main", "block"])
    return two.select("main", (F.col("i") == F.col("block")).alias("same"), "v1", "v2").mapInArrow(run, schema)


def _close_pairs(v1: list, v2: list, share: int):
    """For each node of v1, the places in v2 with another label whose size and sketch allow a link."""
    s1, s2 = (np.frombuffer(b"".join(x["sig"] for x in v), np.uint8).reshape(len(v), -1) for v in (v1, v2))
    l2, n2 = np.array([x["label"] for x in v2]), np.array([x["n"] for x in v2])
    for i, x in enumerate(v1):
        at = np.flatnonzero((l2 != x["label"]) & (100 * np.minimum(n2, x["n"]) >= share * np.maximum(n2, x["n"])))
        if len(at):
            at = at[_agree(s2[at], s1[i]) >= CLOSE]
            if len(at):
                yield i, at


def _rest(members: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, share: int) -> DataFrame:
    """Links (a, b) that join components which share a bucket: enough of them to join all that are linked."""
    lab = keep(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    split = keep(lab.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.when(F.col("node") == F.col("hub"), F.col("label"))).alias("main")).where("lo <> hi").drop("lo", "hi"))
    u = lab.select("key", "node", "label").join(split, "key").select("main", "node", "label").distinct()
    u = keep(u.withColumn("x", F.col("label") != F.col("main")).join(nodes.select("node", "n", "sig"), "node"))

    def near(batches):
        for b in batches:
            for r in range(b.num_rows):
                v1, v2, main = b.column("v1")[r].as_py(), b.column("v2")[r].as_py(), b.column("main")[r].as_py()
                got = set()
                for i, at in _close_pairs(v1, v2, share):
                    got.add(v1[i]["node"])
                    got.update(v2[j]["node"] for j in at)
                yield pa.RecordBatch.from_arrays([pa.array([main] * len(got), pa.int64()), pa.array(list(got), pa.int64())], names=["main", "node"])

    hot = keep(_meet(u, ["sig"], near, "main long, node long").distinct())
    sets = _sets(keep(hot.select("node").distinct()), docs, k)

    def verify(batches):
        for b in batches:
            for r in range(b.num_rows):
                v1, v2 = b.column("v1")[r].as_py(), b.column("v2")[r].as_py()
                s1, s2 = ([np.frombuffer(x["set"], np.uint64) for x in v] for v in (v1, v2))
                root: dict = {}

                def find(x, root=root):
                    while (y := root.get(x, x)) != x:
                        x = y
                    return x

                links = []
                for i, at in _close_pairs(v1, v2, share):
                    for j in at:
                        lx, ly = find(v1[i]["label"]), find(v2[j]["label"])
                        if lx != ly and 100 * (m := _shared(s1[i], s2[j])) >= share * (len(s1[i]) + len(s2[j]) - m):
                            root[lx] = ly
                            links.append((v1[i]["node"], v2[j]["node"]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    u = u.join(hot, ["main", "node"], "left_semi").join(sets, "node")
    return keep(_meet(u, ["sig", "set"], verify, "a long, b long").distinct())


def cluster(docs: DataFrame, k: int = 5, share: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    rows = keep(_sketched(docs, k))
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = keep(classes)
    nodes = classes.where("node IS NOT NULL").select("node", "n", "sig", "bands")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min_by("node", F.xxhash64("node")).alias("hub"), F.min_by("node", F.xxhash64("node", "key")).alias("hub2")).where("m > 1")
    members = keep(keyed.join(keep(groups), "key").drop("m"))
    source = docs.select("doc_id", "text")
    pairs = lambda m, hub: m.where(f"node <> {hub}").select(F.least("node", hub).alias("a"), F.greatest("node", hub).alias("b")).distinct()
    first = _links(pairs(members, "hub"), source, nodes, k, share)
    labels = components(first)
    # the hubs drawn by bucket are asked only where the first ones left a node apart from them
    apart = members.join(labels, "node", "left").join(labels.select(F.col("node").alias("hub2"), F.col("label").alias("label2")), "hub2", "left")
    apart = apart.where("coalesce(label, node) <> coalesce(label2, hub2)").select("node", "hub2")
    second = keep(first.unionByName(_links(pairs(apart, "hub2"), source, nodes, k, share)))
    rest = _rest(members, components(second), nodes, source, k, share)
    labels = components(second.unionByName(rest))
    known = keep(classes.select("cls", "node").join(labels, "node", "left").select("cls", F.coalesce("label", "node").alias("label")))
    out = rows.select("doc_id", "n", "cls").join(known, "cls", "left")
    comp = F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def unique(docs: DataFrame, k: int = 5, share: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each component, and all without shingles or id."""
    gone = keep(cluster(docs, k, share).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    return bloom.without(docs, F.col("doc_id").cast("long"), gone, "doc_id")


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
f AS (SELECT t, count(*) AS f FROM e GROUP BY t),
r AS (SELECT doc_id, n, e.t, row_number() OVER (PARTITION BY doc_id ORDER BY f, e.t) AS i FROM e JOIN f ON e.t = f.t),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM r a JOIN r b ON a.t = b.t AND a.doc_id < b.doc_id
      WHERE a.i <= a.n - (80 * a.n + 99) // 100 + 1 AND b.i <= b.n - (80 * b.n + 99) // 100 + 1 AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM (SELECT c.a, c.b, na, nb, count(*) AS k FROM c JOIN e x ON x.doc_id = c.a JOIN e y ON y.doc_id = c.b AND y.t = x.t GROUP BY ALL) WHERE 100 * k >= 80 * (na + nb - k)),
g AS (WITH RECURSIVE p(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.x, q.b FROM p JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) q ON q.a = p.y) SELECT x, min(y) AS y FROM p GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, y AS component_id, doc_id = y AS kept FROM s JOIN g ON x = doc_id
"""
