"""The operators on small tables of every awkward kind, against plain statements of the same rules."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from wardline.llm import bloom, op1_exact, op2_urls, op4_contamination, op5_near, op6_warc, op8_chat, queries

DOC = "doc_id long, text string, _word long, n int, key string"


def awkward(texts, seed=1):
    r = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, None), (None, ""), (None, texts[0]), (3, texts[3]), (3, texts[3]), (500, None), (501, "   \t\n"), (502, "Word"), (503, "word"), (504, "one two")]
    r.shuffle(rows)
    return [(*x, 7, None, "k") for x in rows]


def prose(seed, n=40):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeE\u00e9") for _ in range(r.randrange(1, 6))) for _ in range(300)]
    texts = []
    for _ in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([3, 20, 60, 200]))]
        texts.append(" ".join(w))
        for _ in range(r.choice([0, 0, 1, 4])):  # near copies, at all distances
            x = list(w)
            for _ in range(max(1, int(len(x) * r.choice([0.01, 0.03, 0.06, 0.1])))):
                x[r.randrange(len(x))] = r.choice(vocab)
            texts.append(" \n".join(x))
    return texts


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_exact(spark):
    rows = awkward([random.Random(i % 17).choice(["a", "b b", "long text " * 50]) + str(i % 13) for i in range(60)])
    df = spark.createDataFrame(rows, DOC).repartition(4)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t, *_ in rows:
        g = groups[t or ""]
        best = max((x for x in g if x is not None), default=None)
        want.append((str(i), str(best), len(g), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    got = sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.kept, x.text_sha256) for x in op1_exact.decisions(df).collect())
    assert got == sorted(want)
    left = op1_exact.unique(df)
    assert left.columns == df.columns
    left = left.collect()
    assert sorted((x.text or "") for x in left) == sorted(groups)
    assert all(x.doc_id == max((y for y in groups[x.text or ""] if y is not None), default=None) for x in left)
    assert op1_exact.decisions(df.limit(0)).count() == op1_exact.unique(df.limit(0)).count() == 0


def test_bloom_never_misses(spark, monkeypatch):
    for size in (64, 1 << 20):
        monkeypatch.setattr(bloom, "MAX_WORDS", size)
        keys = spark.range(3000).selectExpr("xxhash64(id % 2500) AS h", "id")
        got = {r.id: r.m for r in bloom.probe(keys, bloom.repeated(keys, "h", 3000), "h", 3000, "m").collect()}
        assert all(got[i] for i in itertools.chain(range(500), range(2500, 3000)))
        if size > 64:
            assert sum(got.values()) < 1200
        kept = bloom.without(keys, keys.id, spark.range(100, 200).withColumnRenamed("id", "g"), "g")
        assert sorted(r.id for r in kept.collect()) == [*range(100), *range(200, 3000)]


def near_brute(rows, k, share):
    sets = [shingle_set(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        same = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
        if sets[a] and sets[b] and 100 * i >= share * (len(sets[a]) + len(sets[b]) - i) or same:
            # a row without an id equals, but doesn't link on
            if (rows[a][0] is None or rows[b][0] is None) and sets[a] != sets[b]:
                continue
            parent[find(a)] = find(b)
    out = []
    for x, (i, *_) in enumerate(rows):
        ids = [rows[y][0] for y in range(len(rows)) if find(y) == find(x) and rows[y][0] is not None]
        c = min(ids, default=None) if sets[x] else i
        out.append((str(i), len(sets[x]), str(c), i == c))
    return sorted(out)


@pytest.fixture
def small(spark):
    """Many small jobs: one partition each."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_near_duplicates(spark, small, monkeypatch, k=2):
    monkeypatch.setattr(op5_near, "BLOCK", 3)
    rows = awkward(prose(k))
    df = spark.createDataFrame(rows, DOC).repartition(3)
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in op5_near.cluster(df, k).collect())
    want = near_brute(rows, k, 80)
    assert got == want
    monkeypatch.setattr(op5_near, "cluster", lambda *a: spark.createDataFrame([(x[0], x[3]) for x in ((None if g[0] == "None" else int(g[0]), *g[1:]) for g in got)], "doc_id long, kept boolean"))
    left = op5_near.unique(df, k)
    assert left.columns == df.columns
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(w[0] for w in want if w[3] or w[0] == "None")


def test_near_duplicates_of_nothing(spark, small):
    assert op5_near.cluster(spark.createDataFrame([], DOC)).count() == 0


def test_hubs_and_rest_find_every_component(spark, small):
    """A long chain of texts, each near only to its neighbours, and a group about one original."""
    r = random.Random(9)
    w = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        texts.append(" ".join(w))
        w[(i * 7) % 120] = f"x{i}"
    base = [f"b{i}" for i in range(150)]
    for i in range(60):
        x = list(base)
        for j in r.sample(range(150), r.randrange(1, 9)):
            x[j] = f"y{i}_{j}"
        texts.append(" ".join(x))
    rows = [(i, t, 0, 0, "") for i, t in enumerate(texts)]
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in op5_near.cluster(spark.createDataFrame(rows, DOC), 2).collect())
    assert got == near_brute(rows, 2, 80)


def test_contamination(spark):
    r = random.Random(3)
    texts = prose(8, 25)
    items = [(i, " ".join(r.choice(words(t) or ["x"]) for _ in range(r.choice([6, 15, 40])))) for i, t in enumerate(texts[:12])] + [(50, "one two"), (51, ""), (52, None), (50, "one  two")]
    for i, t in items[:12]:
        w = words(t)
        for cut in (0, 1, 3):
            x = w[cut:] if r.random() < 0.5 else [*w[: len(w) // 2], "changed", *w[len(w) // 2 + 1 :]]
            texts.append(f"{r.choice(texts)} {' '.join(x)} {r.choice(texts)}")
    rows = awkward(texts)
    df = spark.createDataFrame(rows, DOC)
    want = set()
    for i, t, *_ in rows:
        for j, q in items:
            a, b = shingle_set(q, 5), shingle_set(t, 5)
            if a and 100 * len(a & b) >= 80 * len(a):
                want.add((i, j, len(a & b), len(a)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.item_id, x.n_shared, x.n_item) for x in op4_contamination.contamination(df, bench).collect()]
    assert sorted(got) == sorted(want)
    assert len(want) > 10
    hit = {w[0] for w in want}
    left = op4_contamination.clean(df, bench)
    assert left.columns == df.columns
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(str(x[0]) for x in rows if x[0] not in hit)
    assert op4_contamination.clean(df.limit(0), bench).count() == 0
    assert op4_contamination.clean(df, bench.limit(0)).count() == len(rows)


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|im_end|>", "a\n", "<|im_start|>assistant\nx", "", None, "%0A%", "<\\\\|", "\U0001f600<|"]
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a%\n<|b", None]), r.choice(odd)) for c in [*range(12), None] for t in r.sample(range(9), r.randrange(1, 9))]
    rows += [(1, None, "assistant", "n"), (2, 3, "assistant", "same"), (2, 3, "assistant", "same")]
    ex = op8_chat.examples(spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, i int"))
    got = {x.conv_id: x for x in op8_chat.digest(ex).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(groups)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), sha(loss))
    for e in ex.collect():
        assert e.text.count("<|im_start|>") == e.text.count("<|im_end|>") == e.example and 0 <= e.mask_start <= e.mask_end <= len(e.text)
    assert op8_chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_urls(spark):
    urls = ["https://A.example.org/es/1", "http://example.org/en/12", "http://x.com/de/1?q", "http://x.com/fr/#a", "http://bad.net/1", "http://good.net/x", "no scheme", "", None, "http://", "ftp://user@h.co.uk:80/p?x://y", "http://127.0.0.1/a", "http://org/", "http://torg/en"]
    rows = [(i, u, 1) for i, u in enumerate(urls)] + [(100 + i, "http://bad.net/z", 1) for i in range(60)] + [(200 + i, "http://good.net/z", 1) for i in range(60)] + [(None, "http://bad.net", 1), (4, urls[4], 1)]
    labels = [(100 + i, 0, None) for i in range(50)] + [(200 + i, 1, 0) for i in range(50)] + [(100, 1, 0), (None, 1, 1), (7, None, None)]
    pages, lab = spark.createDataFrame(rows, "page_id long, url string, host int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = op2_urls.judge(pages.select("page_id", "url"), op2_urls.label_outcomes(lab)).collect()
    con = duckdb.connect()
    p, l = pages.toPandas(), lab.toPandas()  # noqa: E741
    p["url"] = p["url"].astype(object)
    con.register("pages", p[["page_id", "url"]])
    con.register("labels", l)
    want = con.execute(op2_urls.ORACLE).fetchall()
    norm = lambda xs: sorted(tuple("None" if v is None or v != v else str(int(v)) if isinstance(v, (int, float)) else v for v in x) for x in xs)
    assert norm(map(tuple, got)) == norm(want)
    by = {x.page_id: x.verdict for x in got}
    assert by[120] == "block" and by[220] == "allow" and by[0] == "block" and by[12] == "allow"
    assert {x.verdict for x in op2_urls.judge(pages.select("page_id", "url"), op2_urls.label_outcomes(lab.limit(0))).collect() if x.rule is None} == {"allow"}
    assert op2_urls.judge(pages.limit(0).select("page_id", "url"), op2_urls.label_outcomes(lab)).count() == 0


def test_warc(spark):
    page = "<html lang='de'><head><title>A &amp; B</title><script>x<p></script></head><body><p>One<br>two &lt;3<a href=\"/u v\">l</a><!-- no --></body></html>"
    rows = [(1, "http://a.b/\u00e9 x", page, 0), (2, None, None, 0), (None, "", "", 0), (1, "http://a.b/\u00e9 x", page, 0), (3, "u\r\nWARC-Type: x", "plain\r\n\r\ntext", 0)]
    src = op6_warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string, record int"))
    made = op6_warc.derive(src)
    got, first = op6_warc.parse(made).collect(), op6_warc.parse(src).collect()
    assert len(got) == 10 and {x.type for x in first} == {"response"}
    ids = {x.record_id: x for x in first}
    for x in got:
        assert x.refers_to in ids and x.target_uri == ids[x.refers_to].target_uri and x.block_digest == op6_warc.digest(bytes(x.block))
        payload = bytes(ids[x.refers_to].block).partition(b"\r\n\r\n")[2]
        assert x.source_digest == op6_warc.digest(payload)
    one = {x.type: bytes(x.block).decode() for x in got if x.page_id == 1}
    assert one["conversion"] == "A & B\nOne\ntwo <3l" and "title: A & B\r\n" in one["metadata"] and "outlink: /u%20v\r\n" in one["metadata"]
    assert len({x.record_id for x in got}) == 8
    bad = spark.createDataFrame([(1, b"junk"), (2, None), (3, b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")], "page_id long, record binary")
    assert {x.type for x in op6_warc.parse(bad).collect()} == {"invalid"} and op6_warc.derive(bad).count() == 0
    assert op6_warc.derive(src.limit(0)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import oracle

    diff, _ = oracle.compare(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLES[name])
    assert diff is None


def test_components_take_few_rounds(spark, monkeypatch):
    """Chains in order of ids, a star whose hub has the largest id, and repeated and reversed links."""
    chain = [(i, i + 1) for i in range(1000)]
    star = [(5000, 2000 + i) for i in range(500)]
    rows = chain + star + [(7, 6), (6, 7), (9000, 9000), (9001, 9002)]
    rounds = []
    monkeypatch.setattr(op5_near, "store", lambda df, f=op5_near.store: rounds.append(1) or f(df))
    got = {r.node: r.label for r in op5_near.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {i: 0 for i in range(1001)} | {i: 2000 for i in [5000, *range(2000, 2500)]} | {9001: 9001, 9002: 9001}
    assert got == want
    assert len(rounds) <= 4 * 15
    assert op5_near.components(spark.createDataFrame([], "a long, b long")).count() == 0
