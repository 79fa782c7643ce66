"""Which texts mention a known name: exactly, by a distinctive part, or misspelt.

Names and texts are both tables of any size. Few names travel to the tasks that read the texts, which are gone through once
there and leave nothing but ids. With many names every test is an equality join on keys that a matching pair is sure to
share, followed by the exact test on the candidates, so no text is ever compared with the whole dictionary."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed
from wardline.functions import text as X
from wardline.session import cut, small_lookup

_EPS = 1e-9
FEW_NAMES = 2_000       # up to so many names, all names travel to every task
PATTERN_BYTES = 6_000   # bytes of names in one pattern: its automaton stays well within the matcher's memory
SLICE_CHARS = 4 << 20   # characters of texts that are searched for misspelt names at once
_MASK_BITS = 64         # letters of a name that fit into one machine word


def substring_hits(texts: DataFrame, names: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """Ids of texts in which a name occurs as a substring of their tokens joined by single spaces.

    A name of n words covers n neighbouring tokens: it starts with the end of the first, holds the inner ones whole and
    ends with the start of the last; a one-word name lies inside one token. Cutting tokens to the word lengths that names
    really have gives whole names as join keys, so a candidate is already a hit and no two names share a key."""
    few = few_names(names)
    if few is not None:
        return _texts_with(texts, [re.escape(x) for x, in few], id_col, F.array_join(tokens_col, " "), F.size(tokens_col) > 0)
    parts = names.select("name", F.split("name", " ", -1).alias("_p")).withColumn("_n", F.size("_p"))
    shape = parts.select("_n", F.length(F.expr("_p[0]")).alias("_a"), F.length(F.expr("_p[_n - 1]")).alias("_b")).distinct()
    shapes = [tuple(r) for r in shape.collect()]         # bounded by word lengths, not by the number of names
    out = texts.select(id_col).filter(F.lit(False))
    many = sorted(x for x in shapes if x[0] > 1)
    multi = parts.filter("_n > 1")
    if many:
        # which words can be the first or last word of a hit is decided on the vocabulary, far smaller than the text
        vocab = texts.select(F.explode(tokens_col).alias("_w")).distinct()
        lens = lambda i: F.explode(F.array(*[F.lit(n) for n in sorted({x[i] for x in many})]))
        heads = vocab.select("_w", lens(1).alias("_a")).filter("_a <= length(_w)").withColumn("_x", F.expr("right(_w, _a)")).join(
            multi.select(F.expr("_p[0]").alias("_x")).distinct(), "_x", "left_semi").select(F.col("_w").alias("_hw"), "_a")
        tails = vocab.select("_w", lens(2).alias("_b")).filter("_b <= length(_w)").withColumn("_x", F.expr("left(_w, _b)")).join(
            multi.select(F.expr("_p[_n - 1]").alias("_x")).distinct(), "_x", "left_semi").select(F.col("_w").alias("_tw"), "_b")
        w = windows_of(texts, id_col, tokens_col, sorted({x[0] for x in many}))
        ends = w.select("window").distinct().select("window", F.substring_index("window", " ", 1).alias("_hw"), F.substring_index("window", " ", -1).alias("_tw"))
        cut_ = ends.join(heads, "_hw").join(tails, "_tw").select("window", F.expr(
            "substring(window, length(_hw) - _a + 1, length(window) - (length(_hw) - _a) - (length(_tw) - _b))").alias("name"))
        hits = cut_.join(multi.select("name"), "name", "left_semi").select("window").distinct()
        out = out.union(w.join(hits, "window", "left_semi").select(id_col))
    single = sorted(x[1] for x in shapes if x[0] == 1)
    if single:
        # distinct tokens first: the vocabulary is far smaller than the text
        vocab = texts.select(F.explode(tokens_col).alias("_w")).distinct()
        within = vocab.select("_w", F.explode(F.array(*[F.lit(x) for x in single])).alias("_a")).filter(F.col("_a") <= F.length("_w"))
        within = within.select("_w", F.explode(F.transform(F.sequence(F.lit(1), F.length("_w") - F.col("_a") + 1),
                                                     lambda i: F.substring("_w", i, F.col("_a")))).alias("name"))
        words = small_lookup(cut(within.join(small_lookup(parts.filter("_n = 1").select("name")), "name", "left_semi").select("_w").distinct()))
        out = out.union(texts.select(id_col, F.explode(tokens_col).alias("_w")).join(words, "_w", "left_semi").select(id_col))
    return out.distinct()


def part_hits(texts: DataFrame, names: DataFrame, id_col: str, words_col: str,
              min_letters: int = fixed.MIN_NAME_PART) -> DataFrame:
    """Ids of texts with a whole word equal to a distinctive part of a name."""
    few = few_names(names, F.filter(F.split(F.trim("name"), r"\s+"), lambda x: F.length(x) >= min_letters))
    if few is not None:
        marked = F.concat(F.lit(" "), F.array_join(words_col, " "), F.lit(" "))
        return _texts_with(texts, [f" {re.escape(x)} " for x in {x for _, xs in few for x in xs}], id_col, marked, F.size(words_col) > 0)
    parts = (names.select(F.explode(F.split(F.trim("name"), r"\s+")).alias("_w"))
             .filter(F.length("_w") >= min_letters).distinct())
    return (texts.select(id_col, F.explode(F.array_distinct(words_col)).alias("_w")).join(small_lookup(parts), "_w", "left_semi")
            .select(id_col).distinct())


def _budget(a: int, b: int, ratio: float) -> int:
    """Most letters that may be inserted or deleted between lengths a and b at this similarity (or -1)."""
    total = a + b
    d = int((1 - ratio) * total + _EPS)
    d -= (total - d) % 2          # matched letters are counted twice, so d and a+b are both odd or both even
    return d if d >= abs(a - b) else -1


def _pieces(b: int, k: int) -> list[tuple[int, int]]:
    cuts = [b * i // k for i in range(k + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(k)]


def blocking_layout(lengths: list[tuple[int, int]], ratio: float) -> tuple[list[tuple], list[tuple]]:
    """Where to cut names (words, b, offset, length) and windows (words, a, b, offset, length, position): see :func:`blocking_rows`."""
    rows = blocking_rows(lengths, ratio)
    return sorted({(n, b, off, size) for n, _, b, off, size, _ in rows}), rows


def blocking_rows(lengths: list[tuple[int, int]], ratio: float) -> list[tuple]:
    """Where names of given (words, letters) are cut and where windows must hold the same piece.

    A name of b letters within an insert/delete budget d of a window keeps at least one of d+1 pieces undamaged, moved by
    no more than the budget allows (the pigeonhole partition scheme of Pass-Join, Li et al., PVLDB 2011, for insert and
    delete distance): x edits before the piece and the rest of the length difference behind it must fit into d. Where there are
    d+1 pieces, one of the undamaged ones has exactly as many edits before it as pieces (count edits less pieces from the
    left: the sum starts at 0, ends below it and never falls by more than one), so piece j is moved by -j, -j+2 .. j only and
    at most d-j edits follow. Rows are (words, a, b, offset, length, position in the window)."""
    rows = set()
    for n, b in lengths:
        # 2 * b / (a + b) is the largest ratio of lengths a and b, so longer windows can't reach it
        for a in range(1, int(b * (2 / ratio - 1)) + 2):
            d = _budget(a, b, ratio)
            if d < 0:
                continue
            for j, (off, size) in enumerate(_pieces(b, min(d + 1, b))):
                for x in range(-j, j + 1, 2) if d < b else range(-d, d + 1):
                    if abs(a - b - x) <= (d - j if d < b else d - abs(x)) and 0 <= off + x <= a - size:
                        rows.add((n, a, b, off, size, off + x))
    return sorted(rows)


def _ratio_udf(ratio: float):
    @F.pandas_udf("boolean")
    def similar(window: pd.Series, name: pd.Series) -> pd.Series:
        def close(w, n):
            m = SequenceMatcher(None, w, n)
            return m.quick_ratio() >= ratio and m.ratio() >= ratio      # the first is an upper bound of the second

        return pd.Series([close(w, n) for w, n in zip(window, name)], dtype=bool)

    return similar


def similar_windows(windows: DataFrame, names: DataFrame, ratio: float = fixed.FUZZY_NAME_RATIO) -> DataFrame:
    """Pairs (window, name) whose similarity reaches ``ratio``. ``windows`` has distinct ``window`` texts and their word
    count ``n``; only names of the same word count are compared. Lossless: see :func:`blocking_layout`."""
    spark = windows.sparkSession
    nm, lengths = _lengths(names)
    if not lengths:
        return windows.select("window", F.lit(None).cast("string").alias("name")).filter(F.lit(False))
    name_cuts, window_cuts = blocking_layout(lengths, ratio)
    # layouts depend on name lengths only, never on the data volume
    ndf = F.broadcast(spark.createDataFrame(pd.DataFrame(name_cuts, columns=["n", "b", "off", "size"], dtype="int32")))
    wdf = F.broadcast(spark.createDataFrame(pd.DataFrame(window_cuts, columns=["n", "a", "b", "off", "size", "at"], dtype="int32")))
    nk = nm.join(ndf, ["n", "b"]).select("name", "n", "b", "off", F.expr("substring(name, off + 1, size)").alias("piece"))
    wk = windows.withColumn("a", F.length("window")).join(wdf, ["n", "a"]).select(
        "window", "n", "b", "off", F.expr("substring(window, at + 1, size)").alias("piece"))
    cand = wk.join(small_lookup(nk), ["n", "b", "off", "piece"])
    pairs = cand.filter(_near_enough(ratio)).select("window", "name").distinct()
    return pairs.filter(_ratio_udf(ratio)("window", "name"))


def _lengths(names: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    nm = names.select("name", F.size(F.split(F.trim("name"), r"\s+")).alias("n"), F.length("name").alias("b"))
    return nm, [(r.n, r.b) for r in nm.select("n", "b").distinct().collect()]


def _near_enough(ratio: float) -> Column:
    """True for all pairs that can reach ``ratio``: what is inserted and deleted bounds the edits from above."""
    return F.expr(f"levenshtein(window, name, cast(floor({1 - ratio!r}D * (length(window) + length(name)) + {_EPS!r}D) as int)) >= 0")


def few_names(names: DataFrame, *more: Column) -> list[tuple] | None:
    """The names, each with the values of ``more``, if they are at most ``FEW_NAMES``, else None; no more are read than it takes to decide."""
    found = names.filter("name is not null").select("name", *more).limit(FEW_NAMES + 1).collect()
    return [tuple(r) for r in found] if len(found) <= FEW_NAMES else None


def _texts_with(texts: DataFrame, patterns: list[str], id_col: str, text: Column, known: Column) -> DataFrame:
    """Ids of texts in which any of the patterns occurs. Patterns are joined to automata that read a text once, from its first byte
    to its last, however many names they hold."""
    if not patterns:
        return texts.select(id_col).filter(F.lit(False))
    joined, size = [[]], 0
    for x in sorted(set(patterns)):
        size += len(x.encode())
        if joined[-1] and size > PATTERN_BYTES:
            joined.append([])
            size = len(x.encode())
        joined[-1].append(x)
    rules = ["|".join(x) for x in joined]

    def search(batches):
        for b in batches:
            found = pc.match_substring_regex(b.column(1), rules[0])
            for r in rules[1:]:
                found = pc.or_(found, pc.match_substring_regex(b.column(1), r))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(found)], names=[b.schema.names[0]])

    read = texts.filter(known).select(id_col, text.alias("_text"))
    return read.mapInArrow(search, read.select(id_col).schema).distinct()


def _word_places(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, last place (exclusive) and number of the text of every word in texts that lie behind each other in ``codes``."""
    spaces = np.flatnonzero(codes == 32)
    begins = np.concatenate([[0], ends[:-1]])
    # a word ends at a space or with its text; by equal places the space comes first, as its text does
    first = np.sort(np.concatenate([spaces + 1, begins]), kind="stable")
    last = np.sort(np.concatenate([spaces, ends]), kind="stable")
    words = np.diff(np.searchsorted(spaces, np.concatenate([[0], ends]))) + 1
    return first, last, np.repeat(np.arange(len(ends)), words)


def _longest_common(chars: np.ndarray, masks: np.ndarray, which: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``chars`` and its name: one machine word a row holds a column of the
    usual table (bit-parallel, Hyyro 2004). ``masks`` has the places of a character (column) in a name (row) as bits."""
    v = np.full(len(chars), ~np.uint64(0))
    for j in range(chars.shape[1]):
        u = v & masks[which, chars[:, j]]
        v = (v + u) | (v - u)
    inside = np.where(letters >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(letters, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & inside).astype(np.int64)


def _similar(w: str, n: str, ratio: float) -> bool:
    m = SequenceMatcher(None, w, n)
    return m.quick_ratio() >= ratio and m.ratio() >= ratio      # the first is an upper bound of the second


class _Near:
    """Which texts of a slice hold a window similar to a name. Windows are pairs of places in one array, never texts of their own. A
    pair that can reach the ratio differs in at most as many letters as may be inserted or deleted: how often each letter comes,
    modulo four, tells that for all windows of a length at once, the longest common subsequence for what is left, and the
    ratio itself decides."""

    def __init__(self, names: list[tuple[str, int]], ratio: float):
        self.ratio, self.names, self.asked = ratio, [x for x, _ in names], {}
        letters = sorted({c for x, _ in names for c in x})
        self.code = {ord(c): i + 1 for i, c in enumerate(letters)}            # 0: in no name
        self.masks = np.zeros((len(names), len(letters) + 1), dtype=np.uint64)
        for i, (x, _) in enumerate(names):
            for k, c in enumerate(x[:_MASK_BITS]):
                self.masks[i, self.code[ord(c)]] |= np.uint64(1 << k)
        self.size = np.array([len(x) for x, _ in names], dtype=np.int64)
        self.counts = np.zeros(len(names), dtype=np.uint64)
        for i, (x, _) in enumerate(names):
            ones, twos = self._running(self._bit(np.array([ord(c) for c in x], dtype=np.uint32)))
            self.counts[i] = self._counts(ones, twos, np.array([0]), np.array([len(x)]))[0]
        self.by_shape: dict[int, dict[int, list[tuple[int, int]]]] = {}      # words -> letters of a window -> (name, edits)
        for i, (x, n) in enumerate(names):
            for a in range(1, int(len(x) * (2 / ratio - 1)) + 2):
                if (d := _budget(a, len(x), ratio)) >= 0:
                    self.by_shape.setdefault(n, {}).setdefault(a, []).append((i, d))

    @staticmethod
    def _bit(codes: np.ndarray) -> np.ndarray:
        """A bit for every small letter of the alphabet; others share them and five more."""
        return np.uint32(1) << ((codes.astype(np.uint32) - np.uint32(97)) % np.uint32(31))

    @staticmethod
    def _running(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each letter came before every place, modulo four: the ones and the twos of these numbers."""
        ones, twos = np.zeros(len(bits) + 1, dtype=np.uint32), np.zeros(len(bits) + 1, dtype=np.uint32)
        np.bitwise_xor.accumulate(bits, out=ones[1:])
        np.bitwise_xor.accumulate(bits & ones[:-1], out=twos[1:])
        return ones, twos

    @staticmethod
    def _counts(ones: np.ndarray, twos: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each letter comes between two places, modulo four and in Gray code: the bits in which two such words differ are
        no more than the letters by which the texts do."""
        s, e = ones[start], ones[end]
        two = twos[start] ^ twos[end] ^ (s & ~e)
        return (two.astype(np.uint64) << np.uint64(32)) | (s ^ e ^ two)

    def hits(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A flag for each text; ``codes`` has the code points of all, ``ends`` where each ends."""
        first, last, text = _word_places(codes, ends)
        known, place = np.unique(codes, return_inverse=True) if codes.dtype != np.uint8 else (np.arange(256), codes)
        table = np.array([self.code.get(int(c), 0) for c in known], dtype=np.int32)
        ones, twos = self._running(self._bit(known)[place])
        out = np.zeros(len(ends), dtype=bool)
        for n, shapes in self.by_shape.items():
            if len(first) < n:
                continue
            a0, z0 = first[:len(first) - n + 1], last[n - 1:]
            whole = text[:len(first) - n + 1] == text[n - 1:]
            size = np.where(whole, z0 - a0, 0)
            size[size > max(shapes)] = 0
            order = np.argsort(size.astype(np.uint32 if max(shapes) > 65535 else np.uint16), kind="stable")
            cuts = np.searchsorted(size[order], np.arange(max(shapes) + 2))
            for a, pairs in shapes.items():
                at = order[cuts[a]:cuts[a + 1]]
                if not len(at):
                    continue
                start = a0[at]
                mine = self._counts(ones, twos, start, start + a)
                near = [np.flatnonzero(np.bitwise_count(mine ^ self.counts[i]) <= d) for i, d in pairs]
                row = np.concatenate(near)
                if not len(row):
                    continue
                which = np.repeat(np.array([i for i, _ in pairs]), [len(x) for x in near])
                edits = np.repeat(np.array([d for _, d in pairs]), [len(x) for x in near])
                for k in range(0, len(row), 1 << 18):
                    r, w, e = row[k:k + (1 << 18)], which[k:k + (1 << 18)], edits[k:k + (1 << 18)]
                    chars = table[place[start[r][:, None] + np.arange(a)]]
                    left = a + self.size[w] - 2 * _longest_common(chars, self.masks, w, self.size[w]) <= e
                    left |= self.size[w] > _MASK_BITS
                    for p, i in zip(r[left], w[left]):
                        t = text[at[p]]
                        if not out[t]:
                            out[t] = self._ask(codes[start[p]:start[p] + a], i)
        return out

    def _ask(self, codes: np.ndarray, i: int) -> bool:
        key = (codes.tobytes(), codes.dtype.itemsize, int(i))
        if key not in self.asked:
            if len(self.asked) > 200_000:
                self.asked.clear()
            self.asked[key] = _similar("".join(map(chr, codes.tolist())), self.names[i], self.ratio)
        return self.asked[key]


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts behind each other, and where each text ends; bytes where all are of one byte."""
    rows = [x.as_buffer().to_pybytes() for x in texts]
    codes = np.frombuffer(b"".join(rows), dtype=np.uint8)
    if len(codes) and codes.max() >= 128:
        rows = [x.decode("utf-8", "replace") for x in rows]
        codes = np.frombuffer("".join(rows).encode("utf-32-le"), dtype=np.uint32)
    return codes, np.cumsum(np.array([len(x) for x in rows], dtype=np.int64))


def similar_in_place(texts: DataFrame, names: list[tuple[str, int]], id_col: str, words_col: str, ratio: float) -> DataFrame:
    """Ids of texts with a window similar to one of few names (with their numbers of words): the task that reads a text compares its
    windows with all names, and only ids leave it."""
    chars = SLICE_CHARS

    def search(batches):
        near = _Near(names, ratio)
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            part = (ends - 1).clip(0) // chars
            found = [near.hits(*_code_points(b.column(1).slice(s, z - s))) for s, z in _runs(part)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(np.concatenate(found) if found else np.zeros(0, dtype=bool)))], names=[b.schema.names[0]])

    read = texts.filter(F.size(words_col) > 0).select(id_col, F.array_join(words_col, " ").alias("_text"))
    return read.mapInArrow(search, read.select(id_col).schema).distinct()


def _runs(part: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(s, z) for s, z in zip(cuts, cuts[1:]) if z > s]


def windows_of(texts: DataFrame, id_col: str, words_col: str, sizes: list[int]) -> DataFrame:
    """Every run of n neighbouring words, for each n, with its text id."""
    t = texts.select(id_col, F.col(words_col).alias("_t"), F.explode(F.array(*[F.lit(s) for s in sizes])).alias("n"))
    return t.filter(F.size("_t") >= F.col("n")).select(
        id_col, "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("_t") - F.col("n") + 1),
                                           lambda i: F.array_join(F.slice("_t", i, F.col("n")), " "))).alias("window"))


def fuzzy_hits(texts: DataFrame, names: DataFrame, id_col: str, words_col: str,
               ratio: float = fixed.FUZZY_NAME_RATIO) -> DataFrame:
    """Ids of texts with a window similar to a name of the same word count."""
    few = few_names(names, F.size(F.split(F.trim("name"), r"\s+")))
    if few is not None:
        return similar_in_place(texts, sorted(set(few)), id_col, words_col, ratio) if few else texts.select(id_col).filter(F.lit(False))
    sizes = sorted(r[0] for r in names.select(F.size(F.split(F.trim("name"), r"\s+")).alias("n")).distinct().collect())
    w = windows_of(texts, id_col, words_col, sizes)
    hits = similar_windows(w.select("n", "window").distinct(), names, ratio).select("window").distinct()
    return w.join(hits, "window", "left_semi").select(id_col).distinct()


def name_hits(texts: DataFrame, names: DataFrame, id_col: str, col: str, fuzzy: bool = True,
              ratio: float = fixed.FUZZY_NAME_RATIO) -> DataFrame:
    """Distinct ids of texts that mention a known name. The dear test runs only on texts the cheap ones left open."""
    t = cut(texts.select(id_col, X.words(F.col(col)).alias("_words")))     # read by every test below
    cheap = substring_hits(t, names, id_col, "_words").union(part_hits(t, names, id_col, "_words")).distinct()
    if not fuzzy:
        return cheap
    cheap = cut(cheap)
    rest = t.join(cheap, id_col, "left_anti")
    return cheap.union(fuzzy_hits(rest, names, id_col, "_words", ratio))


def raw_name_hits(texts: DataFrame, names: DataFrame, id_col: str, col: str) -> DataFrame:
    """Ids of texts whose plain lower-case text (a space before and after) contains a name, punctuation and all."""
    t = texts.select(id_col, F.split(F.concat(F.lit(" "), F.lower(col), F.lit(" ")), " ", -1).alias("_t"))
    return substring_hits(t, names, id_col, "_t")


def with_name_hit(df: DataFrame, hits: DataFrame, id_col: str, out: str = "name_hit") -> DataFrame:
    return df.join(hits.select(id_col).withColumn(out, F.lit(True)), id_col, "left").withColumn(out, F.coalesce(out, F.lit(False)))
