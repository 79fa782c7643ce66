"""Word BPE against the library, infilling and spelling variants against plain statements of their rules."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from wardline.llm import op11_word_bpe as W
from wardline.llm import op12_fim as M
from wardline.llm import op13_spelling as S

DOC = "doc_id long, text string, `a.b` map<string,int>, row int, value string, _ids int"
AWKWARD = [(None, None), (None, ""), (None, "Null id"), (3, "again"), (3, "again"), (500, None), (501, "   \t\n"), (502, "Word")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, {"k": 1}, 1, "v", None) for i, t in rows], DOC).repartition(3)


# ---------------------------------------------------------------------------------------------------------------- 11


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return W.Vocabulary.load(path("word_bpe_49k.json"))


ODD = ["Hello World's it’s 123 'RE é é İstanbul ẞ", "a<|endoftext|>b <|startoftext|><|endoftext|", "<<|endoftext|>>", "à<|endoftext|>́b", " ́a", "x\x00y\x1cz\x85  　q",
       "'s's 'S 'Ll", "日本語 naïve \U0001f642\U0001f44d\U0001f3fd‍", "ΣΣς ﬁ ǅ K Å", "½²٣ 12", "<|startoftext|>" * 9]


def test_op11_equals_the_library(spark, vocabulary, library):
    r = random.Random(4)
    letters = "aAbB'sStTrReé́İΣς  \x1c<|>\n\t12½²日한ก็🙂‍"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(400)]
    rows = [*enumerate(texts), *AWKWARD]
    coded = W.encode(table(spark, rows), vocabulary)
    assert coded.columns == ["doc_id", "a.b", "row", "value", "_ids", "ids", "n_tokens"]
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    back = W.decode(coded.withColumn("same", coded.ids), vocabulary, "same", "decoded").collect()
    assert Counter((x.doc_id, x.n_tokens, bytes(x.ids), bytes(x.decoded).decode()) for x in back) == want
    assert W.encode(table(spark, rows).limit(0), vocabulary).count() == 0


def test_op11_long_pretokens(vocabulary, library):
    """Pre-tokens of 100,000 characters, below and above the length from which a tree stands alone."""
    r = random.Random(5)
    texts = ["a" * 100_000, "ab" * 50_000, "é" * 30_000, "".join(r.choice("theranionsx") for _ in range(100_000)), *["".join(r.choice("theran") for _ in range(n)) for n in range(W.LONG - 3, W.LONG + 4)]]
    start = time.time()
    for t, got in zip(texts, vocabulary.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert time.time() - start < 60


def test_op11_both_trees_agree_and_forget(vocabulary, library, monkeypatch):
    r = random.Random(6)
    words = list({"".join(r.choice("thereanions") for _ in range(r.randrange(1, 40))).encode() for _ in range(500)})
    many = vocabulary.merge(words)
    monkeypatch.setattr(W, "LONG", 1)
    monkeypatch.setattr(W, "REMEMBERED", 5)
    assert many == vocabulary.merge(words)
    for t in (" ".join(map(bytes.decode, words[i : i + 9])) for i in range(0, 90, 9)):
        assert np.frombuffer(vocabulary.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


# ---------------------------------------------------------------------------------------------------------------- 12

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim_brute(i, t):
    t = t or ""
    u = UNITS.findall(t)
    x = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * j : 8 * j + 8], 16) for j in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
    if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(u), "plain", None, None, sha(t), sha(t)
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return i, len(u), form, len(p), len(m), sha(out), sha(t)


def test_op12_equals_brute_force(spark):
    r = random.Random(7)
    letters = "ab é🙂\n\t\x0b\x0d \x85 <>PSM$1\\"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randrange(40)))) for i in range(600)]
    rows += [(1000 + i, t) for i, t in enumerate(["<P>", "a <S", "<", "P>", "x <M> y", " lead", "trail  ", "$1 \\2 $", "a\nb\n"] * 8)] + AWKWARD
    df = table(spark, rows)
    made = M.transform(df)
    assert made.columns == ["doc_id", "a.b", "row", "value", "_ids", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = Counter(map(tuple, M.digest(made).collect()))
    assert got == Counter(fim_brute(*x) for x in rows)
    assert {"plain", "spm", "psm"} == {x[2] for x in got}
    assert M.transform(df.limit(0)).count() == 0
    again = made.select("text" if "text" in made.columns else M.restore(made.output, made.form).alias("t"), "doc_id").collect()
    assert Counter((x.doc_id, x.t) for x in again) == Counter((i, t or "") for i, t in rows)


def test_op12_long_texts(spark):
    """A million units, a million blanks, one unit of a million characters: no call per unit, no quadratic search."""
    long = ["a " * 1_000_000, " " * 1_000_000, "x" * 1_000_000, "é\n" * 300_000 + " " * 300_000, "<" * 500_000]
    rows = [(i, t) for i in range(3) for t in long]
    start = time.time()
    got = Counter(map(tuple, M.digest(M.transform(table(spark, rows))).collect()))
    assert got == Counter(fim_brute(*x) for x in rows)
    assert time.time() - start < 120


def test_op12_sql(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 20)] + [(4, " "), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    cols = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    assert Counter(con.execute(f"SELECT {cols} FROM ({M.ORACLE})").fetchall()) == Counter(map(tuple, M.digest(M.transform(df)).collect()))


# ---------------------------------------------------------------------------------------------------------------- 13


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def spelling_brute(rows, least=7):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        if xs and n[best := min(xs, key=lambda x: (-n[x], x))] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def edited(r, w, letters):
    i = r.randrange(len(w) + 1)
    return r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]])


@pytest.mark.parametrize("leaf,letters,seed", [(1, "abé", 1), (3, "ab", 2), (24, "abcdeéÿ×", 3)])
def test_op13_equals_brute_force(spark, leaf, letters, seed):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 13))) for _ in range(40)]
    words = base + [edited(r, w, letters) for w in base * 4]
    words += [edited(r, w, letters) for w in words[-80:]]
    weights = [r.choice([1, 1, 2, 25, 300]) for _ in words]
    rows = [(i, " ".join(r.choice([str.upper, str, str])(w) if w.isascii() else w for w in r.choices(words, weights, k=60)) + ".") for i in range(120)] + AWKWARD
    rows += [(900 + i, "chainword" + "x" * 0) for i in range(1100)] + [(2100 + i, "chainwordb") for i in range(90)] + [(2200 + i, "chainwordbb") for i in range(4)]
    got = Counter(map(tuple, S.variants(table(spark, rows), leaf=leaf).collect()))
    assert set(got.values()) == {1}
    assert set(got) == spelling_brute(rows)
    assert any(x[1] and x[2] != x[1] for x in got), "no chain of two forms"
    assert S.variants(table(spark, rows).limit(0)).count() == 0


def test_op13_very_long_words(spark):
    """Words of 50,000 letters: a few variants of one, alike in their first half or their second."""
    r = random.Random(9)
    w = "".join(r.choice("ab") for _ in range(50_000))
    texts = [w, w[:10] + w[11:], w[:-5] + "c" + w[-4:], w[:25_000] + "c" + w[25_000:], "a" * 50_000, "a" * 49_999]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    assert set(map(tuple, S.variants(table(spark, rows)).collect())) == spelling_brute(rows)
