"""Byte-level BPE by overlapping chunks.

Texts of up to CHUNK + OVERLAP code points are pre-tokenised and encoded in one piece. A longer text is dealt out as chunks that each run
OVERLAP code points into the next. Every chunk is pre-tokenised on its own, from wherever it happens to start, which may be inside a
pre-token. The first position at which a chunk and its successor both see a boundary is where they have resynchronised: the pattern never
looks back, so from there on both see the same boundaries, and the first chunk's are right by induction. The pieces between these positions
are then encoded in parallel and their ids concatenated. A text in which some overlap holds no common boundary (one pre-token longer than
the overlap) is encoded whole. Equal long texts are encoded once. Decoding concatenates the bytes of the ids.

Defined results: a null text counts as empty and has no ids; null and repeated ids are rows like any other; extra columns pass through
``encode`` unless they are called like one of its outputs."""

from __future__ import annotations

import base64
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import bloom
from .common import attach, keep, ship

ship(__name__)
CHUNK, OVERLAP = 65_536, 2_048
#: boundaries this close to the end of a chunk may depend on what follows it
MARGIN = 64
#: pre-tokens whose ids a worker remembers
REMEMBERED = 200_000


class Vocabulary:
    """The ranks of a tiktoken file and the pattern that splits texts; sent to the workers as bytes."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern, self.coder, self.table = ranks, pattern, None, None

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.__init__(*state)

    def _pairs(self):
        return ((base64.b64decode(a), int(b)) for a, b in map(bytes.split, self.ranks.splitlines()))

    def _coder(self):
        """What encoding needs; a worker that only decodes never builds it, nor one that encodes the table of tokens."""
        if self.coder is None:
            import regex
            import tiktoken

            piece = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=dict(self._pairs()), special_tokens={})
            self.coder = regex.compile(self.pattern), piece, {}
        return self.coder

    def _table(self) -> list[bytes]:
        if self.table is None:
            ranks = dict(self._pairs())
            table = [b""] * (max(ranks.values()) + 1)
            for k, v in ranks.items():
                table[v] = k
            self.table = table
        return self.table

    def boundaries(self, text: str) -> list[int]:
        """Where the pre-tokens of ``text`` start, and its end."""
        return [0, *(m.end() for m in self._coder()[0].finditer(text))]

    def ids(self, text: str, stop: int | None = None) -> bytes:
        """Ids of ``text``, or of its pre-tokens up to the boundary ``stop``, as little-endian unsigned 32-bit integers."""
        rx, piece, known = self._coder()
        words = rx.findall(text)
        if stop is not None:
            ends = list(accumulate(map(len, words)))
            words = words[: bisect_right(ends, stop)]
        if len(known) > REMEMBERED:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = b"".join(i.to_bytes(4, "little") for i in piece.encode_ordinary(w))
        return b"".join(map(known.__getitem__, words))

    def text(self, ids: bytes) -> bytes:
        return b"".join(map(self._table().__getitem__, memoryview(ids).cast("I")))


def _map(df: DataFrame, columns: str | list[str], out: str, kind: pa.DataType, f, rows: int = 64, keep_columns: bool = False) -> DataFrame:
    """``df`` with ``columns`` replaced by ``out`` = f(values), or with ``out`` beside them, a few rows at a time."""
    columns = [columns] if isinstance(columns, str) else columns
    gone = [] if keep_columns else columns
    schema = T.StructType([x for x in df.schema.fields if x.name not in gone] + [T.StructField(out, T.BinaryType() if kind == pa.binary() else T.ArrayType(T.IntegerType()))])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                new = pa.array(map(f, *(part.column(c).to_pylist() for c in columns)), kind)
                names = [n for n in part.schema.names if n not in gone]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [new], names=[*names, out])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` in place of the text."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary)
    ids = lambda t: vocab.value.ids(t)
    docs = docs.select(*[c for c in docs.columns if c not in (text_col, "ids", "n_tokens")], F.coalesce(text_col, F.lit("")).alias("_text"))
    limit = chunk + overlap
    short = _map(docs.where(F.length("_text") <= limit), "_text", "ids", pa.binary(), ids)
    long = docs.where(F.length("_text") > limit).withColumn("_key", F.sha2("_text", 256))
    rows = keep(long.drop("_text"))
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    done = keep(_encode_long(long.select("_key", "_text"), vocab, chunk, overlap).join(sizes, "_key"))
    rest = [x for x in rows.columns if x != "_key"]
    rows = attach(rows, done, "_key", "_n", F.monotonically_increasing_id()).select(*rest, F.col("_ids").alias("ids"))
    return short.unionByName(rows).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def _encode_long(texts: DataFrame, vocab, chunk: int, overlap: int) -> DataFrame:
    """_key, _ids of each distinct text in ``texts`` (_key, _text), all of them long. The chunks are shuffled once by text and number,
    where copies fall together; after that only boundaries and ids move."""
    last = F.ceil((F.length("_text") - overlap) / chunk).cast("int") - 1
    parts = texts.select("_key", last.alias("last"), F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("_text", i * chunk + 1, F.lit(chunk + overlap)))).alias("no", "part"))
    parts = parts.groupBy("_key", "no", "last").agg(F.any_value("part").alias("part"))

    def ends(t):
        at = vocab.value.boundaries(t)
        head = [x for x in at if x < overlap]
        return [len(head), *head, *(x for x in at[:-1] if chunk <= x <= len(t) - MARGIN)]

    seen = _map(parts, "part", "ends", pa.list_(pa.int32()), ends)
    # positions in the text: the boundaries in the first and in the last overlap of each chunk
    head = F.transform(F.slice("ends", F.lit(2), F.col("ends")[0]), lambda x: x + F.col("no") * chunk)
    tail = F.transform(F.filter("ends", lambda x, i: i > F.col("ends")[0]), lambda x: x + F.col("no") * chunk)
    by, all_ = Window.partitionBy("_key").orderBy("no"), Window.partitionBy("_key")
    cut = F.when(F.col("no") == F.col("last"), F.lit(2**31 - 1)).otherwise(F.array_min(F.array_intersect("tail", F.lead("head").over(by))))
    seen = seen.select("_key", "no", "last", head.alias("head"), tail.alias("tail")).withColumn("to", cut)
    seen = seen.withColumn("from", F.when(F.col("no") == 0, 0).otherwise(F.lag("to").over(by)))
    cuts = keep(seen.select("_key", "no", "from", "to", F.max(F.col("to").isNull()).over(all_).alias("lost")))
    # a piece keeps its chunk's rest behind it: the pattern looks ahead
    pieces = parts.join(cuts.where("NOT lost"), ["_key", "no"]).select("_key", "no", F.expr(f"substring(part, from - no * {chunk} + 1)").alias("piece"), (F.col("to") - F.col("from")).alias("stop"))
    made = _map(pieces, ["piece", "stop"], "ids", pa.binary(), lambda *a: vocab.value.ids(*a))
    joined = made.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("p")).select("_key", F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))").alias("_ids"))
    lost = keep(cuts.where("lost").select("_key").distinct())
    n, h = lost.count(), F.xxhash64("_key")
    whole = bloom.probe(texts.withColumn("_h", h), bloom.members(lost.withColumn("_h", h), "_h", n), "_h", n, "_maybe").where("_maybe").join(lost, "_key", "left_semi")
    whole = whole.groupBy("_key").agg(F.any_value("_text").alias("_text"))
    return joined.unionByName(_map(whole, "_text", "_ids", pa.binary(), lambda t: vocab.value.ids(t), 1))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded", keep_ids: bool = False) -> DataFrame:
    """``df`` with the bytes of the ids in ``out`` in place of the ids, or beside them with ``keep_ids``."""
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary)
    return _map(df, ids_col, out, pa.binary(), lambda b: vocab.value.text(b), keep_columns=keep_ids)
