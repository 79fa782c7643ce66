"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The unit is the word, as written: lower case, accents and look-alike digits folded, punctuation inside it dropped; three or more single
letters in a row also make one unit together. Beside the words, every run of 2 to RUN neighbouring words of at most LONGEST letters is a
unit of its own, read across the blanks: a blank takes one place, as a gap does, and is part of no triple. So an insult with a blank put in
and a phrase of common words are seen; a run counts only where it is stronger than every word and shorter run in it. The kernel of two units counts common subsequences of three letters, each weighted by
DECAY to the power of the stretch it spans (at most SPAN letters), so that gaps and inserted characters cost something but don't break a
match. The kernel with a set of landmark units, whitened (Nyström), gives the features of a linear SVM. Because that kernel is an inner
product over letter triples, the trained machine folds into one weight per triple, and scoring reads every unit of every text once.

Runs take the place of sentences: they go on over sentence ends, and a triple spans SPAN places at most, so that a whole sentence holds no
triple that its runs and words lack, but for those across more than RUN words. A document is as toxic as its strongest units. Training is multiple-instance: of each labelled
toxic text one unit is taken as the witness, at first the one that is most typical of toxic texts, then the one the machine scores highest;
the units of clean texts are negatives: in each round the HARD highest-scoring of them all, the COMMON commonest, and OTHERS by lot. A logistic curve on the document's strongest unit gives
the score.

The classifier is fitted on a bounded sample: at most SAMPLE labelled texts of each class, of at most SAMPLE_CHARS characters each, chosen
by a hash of the id. Everything else reads whole texts and all rows.

Defined results: null and empty texts, and texts without a letter, score what no evidence is worth (below 0.5); repeated rows score alike;
several labels of one id count as toxic if one is; unlabelled and null-labelled ids don't train. Without both classes among the labels all
rows score 0."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

ship(__name__)
SAMPLE, SAMPLE_CHARS = 2_000, 8_000
DECAY, SPAN, LANDMARKS = 0.7, 8, 224
#: letters of a unit that are scored together; longer ones are covered by windows that overlap by half
LONGEST = 24
#: neighbouring words that are read as one
RUN = 4
ROUNDS, PENALTY = 5, 1e-4
#: negatives of a round, of all units of clean texts: the highest-scoring ones, the commonest, and others by lot (words, runs)
HARD, COMMON, OTHERS = 5_000, 5_000, 12_000
#: a text is judged by its WITNESSES strongest units; margins under FLOOR say no less than FLOOR
WITNESSES, FLOOR = 3, -0.8
#: letters of the languages at hand that keep a code of their own; other accents are folded
ACCENTED = "éèêçäöüßñóíá"
#: codes: 0 dropped, 1 to 26 a to z, then ACCENTED, digits, other letters, and what ends a word
DIGIT = 27 + len(ACCENTED)
OTHER, BLANK, SIZE = DIGIT + 1, DIGIT + 2, DIGIT + 3
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s"}


def _codes() -> np.ndarray:
    """Code of each code point under 0x3000; those above are other letters."""
    out = np.zeros(0x3000, np.uint8)
    for i in range(0x3000):
        c = LOOK_ALIKE.get(chr(i), chr(i))
        base = unicodedata.normalize("NFKD", c.lower())[:1]
        if c.isspace():
            out[i] = BLANK
        elif c.lower() in ACCENTED:
            out[i] = 27 + ACCENTED.index(c.lower())
        elif "a" <= base <= "z":
            out[i] = ord(base) - 96
        elif base.isalpha():
            out[i] = OTHER
        elif base.isdigit():
            out[i] = DIGIT
    return out


CODES = _codes()


def _read(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(letters, first, size, text, number): the letter codes of all texts, and where each word starts, its length, its text's number and its own."""
    raw = [np.frombuffer((t + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    points = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
    codes = np.where(points < len(CODES), CODES[np.minimum(points, len(CODES) - 1)], OTHER).astype(np.uint8)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    word = np.cumsum(codes == BLANK)
    real = (codes > 0) & (codes != BLANK)
    letters, word, owner = codes[real], word[real], owner[real]
    if not len(letters):
        none = np.zeros(0, np.int64)
        return letters, none, none, none, none
    first = np.flatnonzero(np.r_[True, np.diff(word) > 0])
    return letters, first, np.diff(np.r_[first, len(letters)]), owner[first], word[first]


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, first, size, text): the letter codes of all texts, and where each word starts, its length and its text's number."""
    return _units(*_read(texts))


def _units(letters, first, size, text, number):
    if not len(letters):
        return letters, first, size, text
    # runs of single letters, word after word
    one = size == 1
    joins = one[1:] & one[:-1] & (text[1:] == text[:-1]) & (np.diff(number) == 1)
    edge = np.diff(np.r_[False, joins, False].astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = end - begin >= 2
    first, size, text = np.r_[first, first[begin[runs]]], np.r_[size, (end - begin + 1)[runs]], np.r_[text, text[begin[runs]]]
    long = size > LONGEST
    if long.any():
        step = LONGEST // 2
        n = -(-(size[long] - LONGEST) // step) + 1
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.minimum(k * step, np.repeat(size[long] - LONGEST, n))
        first = np.r_[first[~long], np.repeat(first[long], n) + start]
        text = np.r_[text[~long], np.repeat(text[long], n)]
        size = np.r_[size[~long], np.full(len(start), LONGEST)]
    return letters, first, size, text


def runs(letters, first, size, text, number) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(row, begin, end, [(k, starts)]): the letters with one blank after each word, where each word begins and ends in them, and for each k
    the words with which a run of k words starts."""
    n = np.arange(len(first))
    row = np.full(len(letters) + len(n), BLANK, np.uint8)
    row[np.arange(len(letters)) + np.repeat(n, size)] = letters
    begin = first + n
    end = begin + size
    ks = range(2, RUN + 1)
    return row, begin, end, [(k, np.flatnonzero((text[k - 1 :] == text[: len(n) - k + 1]) & (end[k - 1 :] - begin[: len(n) - k + 1] <= LONGEST)) if len(n) >= k else n[:0]) for k in ks]


def _triples(n: int) -> list[tuple[int, int, int, float]]:
    return [(i, j, k, DECAY ** (k - i - 2)) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]


def _words(letters: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    return letters[first[:, None] + np.arange(n)].astype(np.int32)


@functools.cache
def _norm(n: int) -> float:
    return max(sum(w * w for *_, w in _triples(n)), 1e-9) ** 0.5


def distinct(letters, first, size) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct units, by length, and for each unit its number among them."""
    number, base, groups = np.zeros(len(first), np.int32), 0, []
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        w = letters[first[at][:, None] + np.arange(n)]
        key = np.ascontiguousarray(w).view(np.dtype((np.void, int(n)))).ravel()
        if n <= 8:
            key = np.pad(w, ((0, 0), (0, 8 - n))).view(np.uint64).ravel()
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        number[at] = base + back
        base += len(one)
        groups.append(w[one])
    return groups, number


def features(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over the triples of each word (rows of equal length) of the triple's rows in ``weights``, normalised by length."""
    block = 50_000 if weights.ndim == 1 else 4_000
    if len(words) > block:
        return np.concatenate([features(words[i : i + block], weights) for i in range(0, len(words), block)])
    n = words.shape[1]
    norm = np.array([_norm(m) for m in range(n + 1)], np.float32)[(words != BLANK).sum(1)]
    out = np.zeros((len(words), *weights.shape[1:]), np.float32)
    col = np.ascontiguousarray(words.T).astype(np.int64)
    for i, j, k, w in _triples(n):
        out += np.float32(w) * weights.take((col[i] * SIZE + col[j]) * SIZE + col[k], axis=0, mode="clip")
    return (out.T / norm).T


def _explicit(word: np.ndarray) -> np.ndarray:
    word = word.astype(int)
    out = np.zeros(SIZE**3, np.float32)
    for i, j, k, w in _triples(len(word)):
        if BLANK not in (word[i], word[j], word[k]):
            out[(word[i] * SIZE + word[j]) * SIZE + word[k]] += w
    return out / _norm(int((word != BLANK).sum()))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = 12, block: int = 4096) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by Newton steps; the last is the bias. Rows are taken a block at a time."""
    n, d = x.shape[0], x.shape[1] + 1
    w = np.zeros(d)
    ridge = penalty * np.diag(np.r_[np.ones(d - 1), 1e-3])
    weight = weight / weight.sum()
    for _ in range(steps):
        left, right = ridge.copy(), np.zeros(d)
        for i in range(0, n, block):
            rows = np.c_[x[i : i + block], np.ones(min(block, n - i))].astype(np.float64)
            target = y[i : i + block]
            on = target * (rows @ w) < 1
            rows, target = rows[on], target[on]
            scaled = rows * weight[i : i + block][on][:, None]
            left += scaled.T @ rows
            right += scaled.T @ target
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


class Model:
    """One weight per letter triple, and the curve from the margins of the strongest units to a score."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.curve = weights, bias, np.r_[1.0, np.zeros(WITNESSES)]

    def margins(self, texts: list[str]) -> np.ndarray:
        """The margins of the strongest distinct units of each text, strongest first; FLOOR where there is no evidence."""
        out = np.full((len(texts), WITNESSES), FLOOR)
        read = _read(texts)
        letters, first, size, text = _units(*read)
        if len(first):
            groups, number = distinct(letters, first, size)
            each = np.concatenate([features(w, self.weights) for w in groups]) + self.bias
            plain = read[2] <= LONGEST
            words = np.full(len(plain), -np.inf)
            words[plain] = each[number[: plain.sum()]]
            row, at, length, owner = self._strong_runs(read, words)
            if len(at):
                more, which = distinct(row, at, length)
                each = np.r_[each, np.concatenate([features(w, self.weights) for w in more]) + self.bias]
                text, number = np.r_[text, owner], np.r_[number, which + sum(map(len, groups))]
            some = each[number] > FLOOR
            text, number = np.unique(np.stack([text[some], number[some]]), axis=1)
            order = np.lexsort((-each[number], text))
            text, number = text[order], number[order]
            rank = np.arange(len(text)) - np.searchsorted(text, text)
            top = rank < WITNESSES
            out[text[top], rank[top]] = each[number[top]]
        return out

    def _strong_runs(self, read, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, first, size, text) of the runs over FLOOR that are stronger than every word and shorter run in them. ``words``: the margins
        of the words. The triples of a run are a difference of running sums, one for each stretch that a triple spans."""
        row, begin, end, starts = runs(*read)
        code = row.astype(np.int64)
        middle, sums = code * SIZE, {}
        for n in range(3, SPAN + 1):
            m = max(len(row) - n + 1, 0)
            ends = code[:m] * (SIZE * SIZE) + code[n - 1 : n - 1 + m]
            got = np.zeros(m, np.float32)
            for j in range(1, n - 1):
                got += self.weights.take(ends + middle[j : j + m], mode="clip")
            sums[n] = np.r_[0, np.cumsum(got, dtype=np.float64) * DECAY ** (n - 3)]
        norms = np.array([_norm(n) for n in range(LONGEST + 1)])
        best, out = words, []
        for k, s in starts:
            best = np.maximum(best[:-1], best[1:]) if len(best) > 1 else best[:0]
            a, b = begin[s], end[s + k - 1]
            total = np.zeros(len(s))
            for n, p in sums.items():
                some = slice(None) if n == 3 else np.flatnonzero(b - a >= n)
                total[some] += p[b[some] - n + 1] - p[a[some]]
            margin = total / norms[b - a - k + 1] + self.bias
            ok = (margin > best[s]) & (margin > FLOOR)
            best[s] = np.maximum(best[s], margin)
            out.append((a[ok], (b - a)[ok], read[3][s[ok]]))
        return row, *map(np.concatenate, zip(*out))

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins @ self.curve[:-1] + self.curve[-1], -30, 30)))


class _Block:
    """The distinct units of a few texts: ``groups`` (letters, by length), ``text`` and ``unit`` (which text holds which), ``run`` (the
    units that are runs) and ``inside`` (the words in each of those), ``words`` (the units that are words)."""

    def __init__(self, texts: list[str], start: int):
        read, small = _read(texts), np.int32
        letters, first, size, text = _units(*read)
        row, begin, end, starts = runs(*read)
        n_words, plain = len(first), np.cumsum(read[2] <= LONGEST) - 1
        first = np.concatenate([first, *[len(letters) + begin[s] for _, s in starts]])
        size = np.concatenate([size, *[end[s + k - 1] - begin[s] for k, s in starts]])
        text = np.concatenate([text, *[read[3][s] for _, s in starts]])
        self.groups, number = distinct(np.r_[letters, row], first, size)
        self.bounds = np.cumsum([0, *map(len, self.groups)])
        self.run, at = np.unique(number[n_words:], return_index=True)
        begins, ks = np.concatenate([s for _, s in starts])[at], np.repeat([k for k, _ in starts], [len(s) for _, s in starts])[at]
        self.inside = np.stack([number[plain[begins + np.minimum(i, ks - 1)]] for i in range(RUN)], 1).astype(small)
        self.words = np.unique(number[:n_words])
        pairs = np.unique(text * np.int64(max(1, self.bounds[-1])) + number)
        self.text, self.unit = (pairs // max(1, self.bounds[-1]) + start).astype(small), (pairs % max(1, self.bounds[-1])).astype(small)
        #: number of each unit among those of all blocks
        self.all = np.zeros(0, small)

    def hashes(self) -> np.ndarray:
        return np.concatenate([_hashes(w) for w in self.groups]) if self.groups else np.zeros(0, np.uint64)

    def own(self, x: np.ndarray) -> np.ndarray:
        """``x`` of each unit; a run no stronger than a word in it has none."""
        x = x.copy()
        x[self.run] = np.where(x[self.run] > x[self.inside].max(1), x[self.run], -1e9) if len(self.run) else 0
        return x

    def score(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return self.own(np.concatenate([features(g, weights) for g in self.groups]) + np.float32(bias)) if self.groups else np.zeros(0)


def _hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of units of one length."""
    n = words.shape[1]
    with np.errstate(over="ignore"):
        odd = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
        h = ((words.astype(np.uint64) + np.uint64(1)) * (odd * odd * odd | np.uint64(1))).sum(1, dtype=np.uint64) + np.uint64(n) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class _Units:
    """The units of all blocks: in how many toxic and clean texts each stands, and which are words."""

    def __init__(self, texts: list[str], y: np.ndarray):
        self.blocks, start = [], 0
        for part in in_parts(texts):
            self.blocks.append(_Block(part, start))
            start += len(part)
        each = [b.hashes() for b in self.blocks]
        known = np.unique(np.concatenate(each))
        n = self.n = len(known)
        self.pos, self.neg = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.size, self.word = np.zeros(n, np.uint8), np.zeros(n, bool)
        for b, h in zip(self.blocks, each, strict=True):
            b.all = np.searchsorted(known, h).astype(np.int32)
            toxic = y[b.text] == 1
            for count, some in ((self.pos, toxic), (self.neg, ~toxic)):
                count[b.all] += np.bincount(b.unit[some], minlength=len(b.all)).astype(np.int32)
            for i, g in enumerate(b.groups):
                self.size[b.all[b.bounds[i] : b.bounds[i + 1]]] = g.shape[1]
            self.word[b.all[b.words]] = True
            del b.words

    def rows(self, ids: np.ndarray):
        """(places in ``ids``, their letters): the units ``ids`` (sorted), each once, by block and length."""
        left = np.ones(len(ids), bool)
        for b in self.blocks:
            at = np.minimum(np.searchsorted(ids, b.all), len(ids) - 1)
            hit = np.flatnonzero((ids[at] == b.all) & left[at])
            left[at[hit]] = False
            group = np.searchsorted(b.bounds, hit, "right") - 1
            for g in np.unique(group):
                some = hit[group == g]
                yield at[some], b.groups[g][some - b.bounds[g]]

    def strongest(self, scores: list[np.ndarray], most: int, clean_only: bool) -> np.ndarray:
        """The ``most`` units with the highest scores, of those that clean texts use or of all."""
        ids, got = [], []
        for b, s in zip(self.blocks, scores, strict=True):
            at = np.flatnonzero(self.neg[b.all] > 0) if clean_only else np.arange(len(s))
            if len(at) > most:
                at = at[np.argpartition(-s[at], most - 1)[:most]]
            ids.append(b.all[at])
            got.append(s[at])
        ids, got = np.concatenate(ids), np.concatenate(got)
        ids, one = np.unique(ids, return_index=True)
        return ids[np.lexsort((ids, -got[one]))[:most]]


def in_parts(texts: list[str], most: int = 400_000):
    """``texts`` in parts of about ``most`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _fit(texts: list[str], y: np.ndarray, seed: int = 7) -> Model:
    """Units are read, counted and scored a few texts at a time; what is held for all texts is a few numbers per unit."""
    rng = np.random.default_rng(seed)
    u = _Units(texts, y)
    expected = (u.pos + u.neg).astype(np.float32) * np.float32((y == 1).mean())
    typical = (u.pos - expected) / np.sqrt(expected + 1)
    typical[u.size < 3] = -1e9
    scores = [b.own(typical[b.all]) for b in u.blocks]
    del expected, typical
    # landmarks: the most typical units of toxic texts, the commonest, and some others
    common = np.argsort(-(u.pos + u.neg), kind="stable").astype(np.int32)
    marks = dict.fromkeys([*u.strongest(scores, LANDMARKS // 2, False), *common[: LANDMARKS // 8]])
    marks |= dict.fromkeys(rng.permutation(np.flatnonzero(u.word).astype(np.int32))[: LANDMARKS - len(marks)])
    phi = np.stack([_explicit(w) for _, words in u.rows(np.sort(np.array(list(marks)))) for w in words])
    val, vec = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    ok = val > 1e-4 * val.max()
    table = phi.T @ (vec[:, ok] / np.sqrt(val[ok])).astype(np.float32)
    del phi
    w, weights = None, None
    common = common[u.neg[common] > 0][:COMMON].copy()
    others = [np.flatnonzero((u.neg > 0) & some).astype(np.int32) for some in (u.word, ~u.word)]
    for r in range(ROUNDS):
        # the strongest units of each toxic text
        witness = np.zeros(u.n, np.float32)
        for b, score in zip(u.blocks, scores, strict=True):
            toxic = y[b.text] == 1
            t, n = b.text[toxic], b.unit[toxic]
            order = np.lexsort((-score[n], t))
            t, n = t[order], n[order]
            rank = np.arange(len(t)) - np.searchsorted(t, t)
            sure = (rank == 0) | (rank < WITNESSES) & (score[n] > (2 if r == 0 else 0))
            np.add.at(witness, b.all[n[sure]], 1)
        clean = np.unique(np.concatenate([u.strongest(scores, HARD, True), common, *[rng.choice(o, min(OTHERS, len(o)), replace=False) for o in others]]))
        # a unit that clean texts use about as often says nothing
        good = np.flatnonzero((witness > 0) & (u.neg <= 0.15 * u.pos) & (u.pos > 1))
        clean = np.setdiff1d(clean, good)
        if not len(good) or not len(clean):
            break
        at, target = np.r_[good, clean], np.r_[np.ones(len(good)), -np.ones(len(clean))]
        x = np.zeros((len(at), table.shape[1]), np.float32)
        order = np.argsort(at)
        for places, words in u.rows(at[order]):
            x[order[places]] = features(words, table)
        gain, loss = np.sqrt(witness[good].astype(float)), np.sqrt(u.neg[clean])
        w = _svm(x, target, np.r_[gain / gain.sum(), loss / loss.sum()])
        del x
        weights = table @ w[:-1].astype(np.float32)
        del scores
        scores = [b.score(weights, w[-1]) for b in u.blocks]
    del u, scores
    if w is None:
        return Model(np.zeros(SIZE**3, np.float32), -1.0)
    model = Model(weights, float(w[-1]))
    # logistic curve; toxic texts weigh half as much as clean ones
    z = np.c_[np.concatenate([model.margins(part) for part in in_parts(texts)]), np.ones(len(texts))]
    c = np.where(y == 1, 0.35 / (y == 1).sum(), 0.65 / (y == 0).sum())
    curve, ridge = np.zeros(WITNESSES + 1), 1e-4 * np.diag([*[1.0] * WITNESSES, 0.01])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        h = (z * (c * p * (1 - p))[:, None]).T @ z + ridge
        curve = curve - np.linalg.solve(h, z.T @ (c * (p - (y == 1))) + ridge @ curve)
    model.curve = np.r_[np.maximum(curve[:-1], 0), curve[-1]]
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model | None:
    """Fit on at most ``sample`` texts of each class, from rows that aren't held out. ``labels``: doc_id, toxic."""
    once = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # ids first, so that only the sample's texts are fetched
    rows = docs.where((F.length("text") > 0) & (F.length("text") <= chars)).select("doc_id").join(once, "doc_id").distinct()
    picked = [r for y in (1, 0) for r in rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not picked:
        return None
    ids = F.broadcast(docs.sparkSession.createDataFrame(picked, rows.schema))
    got = docs.where((F.length("text") > 0) & (F.length("text") <= chars)).select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["doc_id"])

    def fit(batches):
        rows = sorted(r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True))
        texts = list(dict.fromkeys((t, y) for _, t, y in rows))
        y = np.array([t for _, t in texts])
        if len(set(y)) == 2:
            m = _fit([t for t, _ in texts], y)
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype("<f4").tobytes()]), pa.array([m.bias]), pa.array([m.curve.tolist()])], names=["weights", "bias", "curve"])

    # the sample is bounded, so one task holds it; only the machine comes to the driver
    made = got.select("doc_id", "text", "toxic").repartition(1).mapInArrow(fit, "weights binary, bias double, curve array<double>").collect()
    if not made:
        return None
    model = Model(np.frombuffer(bytes(made[0].weights), "<f4"), made[0].bias)
    model.curve = np.array(made[0].curve)
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` from 0 to 1."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one weight per triple: about 108 kB
    names = [c for c in docs.columns if c != out]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out, T.DoubleType())])

    def run(batches, most=400_000):
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            got, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size > most:
                    got.append(sent.value.scores(sent.value.margins(part)))
                    part, size = [], 0
            if part:
                got.append(sent.value.scores(sent.value.margins(part)))
            new = pa.array(np.concatenate(got) if got else np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [new], names=[*names, out])

    return docs.select(*names).mapInArrow(run, schema)
