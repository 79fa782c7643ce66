"""Word-level BPE by segment trees over the ranks of adjacent pairs.

Each pre-token is a row of symbols. The leaves of its tree hold, for every symbol that still has a right neighbour, the rank of that pair
and its place; every inner node holds the least of its two children, so the root is the leftmost pair of the lowest rank. That pair is
merged, which changes three leaves (the pair, the one before it and the one that vanished), and their paths to the root are renewed: a
merge costs the logarithm of the length, and the work ends when the root holds no pair. Many pre-tokens are merged at once, as rows of one
array of trees of equal size; a pre-token of any length is such a row.

What the vocabulary's file says of texts is followed: special tokens are looked for first, in the text as it is; then come composition
(NFC), blanks, lower case, the split into letters, digits and other characters, and bytes; the last symbol of a pre-token ends a word.
None of these looks across a blank, so a text is read as its blank-separated stretches, and a worker remembers the ids of stretches it has
seen (two generations of REMEMBERED each, so that common ones stay). Decoding puts a blank between tokens, as the file names no decoder.

Defined results: a null text counts as empty and has no ids; repeated rows, null and repeated ids come out as they came in; other columns
pass through, whatever their names, except those called like an output. All work is row by row: no shuffle, memory by batches of texts."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)
REMEMBERED = 250_000
#: characters of text, and symbols of trees, that are worked on at once
BATCH, FOREST = 2_000_000, 1 << 19
#: bytes from which a pre-token has a tree to itself
LONG = 256
#: no pair; above every (rank, place)
NONE = np.int64(1) << 62
PLACE = np.int64(32)
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
BLANKS = re.compile(r"[\x20\x09-\x0D]+")


class Vocabulary:
    """The file of a tokenizer (BPE with word ends); sent to the workers as text."""

    def __init__(self, text: str):
        self.text, self.ready = text, False

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def __getstate__(self):
        return self.text

    def __setstate__(self, state):
        self.text, self.ready = state, False

    def _prepare(self) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        d = json.loads(self.text)
        model, end = d["model"], d["model"]["end_of_word_suffix"]
        ids = dict(model["vocab"])
        parts = Tokenizer.from_str(self.text)
        self.normal, self.split = parts.normalizer.normalize_str, parts.pre_tokenizer.pre_tokenize_str
        special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.special = special
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # symbols of single bytes, inside and at the end of a word; a byte shows as one character, which the file's own rule names
        show = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        shown = {c: i for i, c in enumerate(_byte_names(show))}
        self.byte = np.array([ids[c] for c in shown], np.int64)
        self.last = np.array([ids[c + end] for c in shown], np.int64)
        self.value = shown
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = max(max(ids.values()), *special.values()) + 1 if special else max(ids.values()) + 1
        key = np.array([ids[a] * size + ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.size, self.pairs, self.rank, self.made = np.int64(size), key[order], order.astype(np.int64), made[order]
        self.merges = {k: (i, m) for i, (k, m) in enumerate(zip(key.tolist(), made.tolist(), strict=True))}
        tokens = [b""] * size
        for t, i in (*ids.items(), *special.items()):
            tokens[i] = t.encode("utf-8")
        self.tokens, self.known, self.older, self.ready = tokens, {}, {}, True

    # -- segment trees -------------------------------------------------------------------------------------------------------------

    def _keys(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank and place of the pairs a, b as one number, what they merge to); NONE where they don't merge. Negative symbols are none."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        ok = (a >= 0) & (b >= 0) & (self.pairs[at] == want)
        return np.where(ok, (self.rank[at] << PLACE) | place, NONE), self.made[at]

    def _forest(self, words: list[bytes], cap: int) -> list[np.ndarray]:
        """Ids of words of at most ``cap`` (a power of two) bytes, one tree per word."""
        w = len(words)
        sizes = np.fromiter(map(len, words), np.int64, w)
        sym = np.full((w, cap + 1), -1, np.int64)
        inside = np.arange(cap + 1) < sizes[:, None]
        sym[inside] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        tail = np.fromiter((x[-1] for x in words), np.int64, w)
        sym[np.arange(w), sizes - 1] = self.last[tail]
        places = np.arange(cap, dtype=np.int64)
        nxt = np.tile(np.arange(1, cap + 2), (w, 1))
        prev = np.tile(np.arange(-1, cap), (w, 1))
        tree = np.full((w, 2 * cap), NONE, np.int64)
        tree[:, cap:] = self._keys(sym[:, :-1], sym[:, 1:], places[None, :])[0]
        size = cap
        while size > 1:
            half = size // 2
            tree[:, half:size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size = half
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            i = tree[rows, 1] & ((np.int64(1) << PLACE) - 1)
            j = nxt[rows, i]
            sym[rows, i] = self._keys(sym[rows, i], sym[rows, j], i)[1]
            sym[rows, j] = -1
            k = nxt[rows, j]
            nxt[rows, i] = k
            more = k < cap
            prev[rows[more], k[more]] = i[more]
            h = prev[rows, i]
            here, before = sym[rows, i], np.where(h >= 0, sym[rows, np.maximum(h, 0)], -1)
            after = np.where(more, sym[rows, np.minimum(k, cap)], -1)
            self._update(tree, rows, j, np.full(len(rows), NONE), cap)
            self._update(tree, rows, i, self._keys(here, after, i)[0], cap)
            some = h >= 0
            self._update(tree, rows[some], h[some], self._keys(before, here, h)[0][some], cap)
            rows = rows[tree[rows, 1] < NONE]
        return [r[r >= 0] for r in sym]

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, cap: int) -> None:
        at = leaf + cap
        tree[rows, at] = value
        while cap > 1:
            at, cap = at >> 1, cap >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def _tree(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the same tree, its leaves renewed one by one."""
        n, cap = len(word), 1 << (len(word) - 1).bit_length()
        none, size, merges = int(NONE), int(self.size), self.merges
        sym = array("q", self.byte[np.frombuffer(word, np.uint8)].tobytes())
        sym[n - 1] = int(self.last[word[-1]])
        nxt, prev = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        leaves = np.full(cap, NONE)
        s = np.frombuffer(sym, np.int64)
        leaves[: n - 1] = self._keys(s[:-1], s[1:], np.arange(n - 1))[0]
        del s
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = array("q", np.concatenate([np.array([NONE]), *levels[::-1]]).tobytes())
        del leaves, levels

        def renew(i: int, value: int) -> None:
            at = i + cap
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least

        def pair(i: int, j: int) -> int:
            got = merges.get(sym[i] * size + sym[j])
            return none if got is None else got[0] << 32 | i

        while tree[1] < none:
            i = tree[1] & 0xFFFFFFFF
            j = nxt[i]
            sym[i], sym[j] = merges[sym[i] * size + sym[j]][1], -1
            k = nxt[i] = nxt[j]
            renew(j, none)
            if k < n:
                prev[k] = i
            renew(i, pair(i, k) if k < n else none)
            if prev[i] >= 0:
                renew(prev[i], pair(prev[i], i))
        out = np.frombuffer(sym, np.int64)
        return out[out >= 0]

    def merge(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each of ``words`` (distinct, not empty), as little-endian unsigned 32-bit integers."""
        out, by = {}, {}
        for w in words:
            if len(w) > LONG:
                out[w] = self._tree(w).astype("<u4").tobytes()
                continue
            by.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(w)
        for cap, group in by.items():
            step = max(1, FOREST // cap)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                for w, ids in zip(part, self._forest(part, cap), strict=True):
                    out[w] = ids.astype("<u4").tobytes()
        return out

    # -- texts ---------------------------------------------------------------------------------------------------------------------

    def _words(self, stretch: str) -> list[bytes]:
        """The pre-tokens of a stretch without blanks and special tokens."""
        if stretch.isascii():
            return [x.encode() for x in ASCII_SPLIT.findall(stretch.lower())]
        value = self.value
        return [bytes(map(value.__getitem__, x)) for x, _ in self.split(self.normal(stretch))]

    def _pieces(self, stretch: str) -> list[bytes | int]:
        """Pre-tokens, and ids of special tokens, of a stretch without blanks."""
        if not self.specials or not self.specials.search(stretch):
            return self._words(stretch)
        return [x for part in self.specials.split(stretch) if part for x in ([self.special[part]] if part in self.special else self._words(part))]

    def _learn(self, stretches: set[str]) -> None:
        """Put the ids of ``stretches`` among the known ones."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = []
        for s in stretches:
            if s not in self.known:
                if s in self.older:
                    self.known[s] = self.older[s]
                else:
                    new.append(s)
        pieces = {s: self._pieces(s) for s in new}
        ids = self.merge(list({w for p in pieces.values() for w in p if isinstance(w, bytes)}))
        for s, p in pieces.items():
            self.known[s] = b"".join(ids[x] if isinstance(x, bytes) else x.to_bytes(4, "little") for x in p)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.ready:
            self._prepare()
        out, part, size = [], [], 0
        for i, t in enumerate(texts):
            part.append(BLANKS.split(t))
            size += len(t)
            if size > BATCH or i == len(texts) - 1:
                self._learn({s for p in part for s in p})
                out += [b"".join(map(self.known.__getitem__, p)) for p in part]
                part, size = [], 0
        return out

    def decode(self, ids: bytes) -> bytes:
        if not self.ready:
            self._prepare()
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _byte_names(show) -> list[str]:
    """The character by which each byte is shown: as itself where it prints, the others in turn from U+0100 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    names = [chr(b) if b in printed else chr(next(rest)) for b in range(256)]
    if show("é")[0][0] != "".join(names[b] for b in "é".encode()):
        raise ValueError("the file shows bytes in another way")
    return names


def _map(df: DataFrame, column: str, out: str, kind: str, f) -> DataFrame:
    """``df`` with ``column`` replaced by ``out`` = f(values); the other columns are packed, so that their names cannot matter."""
    rest = [c for c in df.columns if c not in (column, out)]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("row"), F.col(f"`{column}`").alias("value"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                new = f(part.column("value").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(new, pa.binary())], names=["row", "value"])

    done = packed.mapInArrow(run, packed.select("row", F.lit(None).cast("binary").alias("value")).schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in rest], F.col("value").alias(out))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` in place of the text."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "n_tokens"])
    coded = _map(docs, text_col, "ids", "binary", lambda texts: vocab.value.encode([t or "" for t in texts]))
    return coded.withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long"))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text (UTF-8 bytes) of the ids in ``out`` in place of the ids."""
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary)
    return _map(df, ids_col, out, "binary", lambda ids: [vocab.value.decode(b or b"") for b in ids])
