"""Secrets by pattern, and weak candidates by the company they keep.

Base kinds (assign, access, hex) are reported wherever their pattern matches. Weak kinds are common in clean texts and say nothing alone:
``ident`` (an access identifier: user, login, client or key id with a value), ``key`` (40 characters of base64 with upper case, lower
case and digits, or a value called pwd, pass, auth, signature or private key) and ``endpoint`` (a URL with a host, or host:port). They are
linked by an interval join: a weak span is reported if, within WINDOW code points, there stand a secret and one more part: identifier or
endpoint. A key needs an identifier or endpoint near it; an identifier or endpoint needs a secret near it (a key or a base span). With
``ids=ACCESS_IDS`` a base span of kind access is an identifier for keys as well: an AKIA id and a bare 40-character secret are a pair.
The names of weak kinds match in either case, at the start of a word or after ``_`` (DB_USER=, aws_access_key_id=).

Positions come from SQL alone: ``split`` and ``regexp_extract_all`` give the stretches between and in the matches in turn, and their
lengths add up. Base spans are found first and weak spans that overlap one are dropped.

Defined results: a null text counts as empty; repeated rows are judged each on its own, alike; spans are ordered by start, then by kind as
in KINDS. Candidates are joined by cells of WINDOW code points, so a text full of them meets only its neighbours; the join asks whether a
partner exists and emits no pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENT = r"(?<![A-Za-z0-9])(?i:user(?:name)?|login|client_?id|access_?key_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{4,}"
KEY = r"(?<![A-Za-z0-9])(?i:pwd|pass|auth|signature|private_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_-])"
#: a host starts where no longer one does, so that a run of labels is read once; its group is possessive, which Java matches in a loop
HOST = r"(?<![a-z0-9-])(?<![a-z0-9-]\.)(?:(?<![A-Z_])|(?=-))[a-z0-9-]++(?:\.[a-z0-9-]++)++"
ENDPOINT = rf"\b[a-z][a-z0-9+]{{1,15}}://[A-Za-z0-9.-]+(?::[0-9]+)?|{HOST}:[0-9]{{2,5}}\b"
WINDOW = 256
#: base kinds that serve a key as its identifier
ACCESS_IDS = ("access",)

#: literals without one of which a pattern cannot match; looked for in the lower-cased text
WORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "ident": ("user", "login", "client", "access", "key"), "endpoint": ("://", ":")}
BLOCK = 256
NOTHING = "CAST(array() AS array<int>)"


def _starts(lengths: Column) -> Column:
    """Running sums before each element, in blocks, so that no fold copies a long array again and again."""
    zero, none = F.lit(0), F.expr(NOTHING)
    part = lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))
    fold = lambda items, first, add: F.aggregate(items, F.struct(first.alias("at"), none.alias("seen")), lambda a, x: F.struct(
        (a["at"] + add(x)).alias("at"), F.concat(a["seen"], F.array(a["at"])).alias("seen")))["seen"]
    blocks = F.sequence(zero, F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    firsts = fold(blocks, zero, lambda b: F.aggregate(part(b), zero, lambda a, x: a + x))
    return F.when(F.size(lengths) > 0, F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), firsts.alias("f")), lambda z: fold(part(z["b"]), z["f"], lambda x: x)))).otherwise(none)


def _with_spans(d: DataFrame, kinds: dict[str, tuple[str, Column]]) -> DataFrame:
    """``d`` with a column of spans (array<struct<s, k, e>>) per kind, from its pattern and the test that lets a text be searched."""
    sizes = lambda c: F.transform(c, lambda x: F.length(x))
    none = F.expr(NOTHING)
    d = d.withColumns({f"q_{k}": F.coalesce(q, F.lit(False)) for k, (_, q) in kinds.items()})
    lens = {}
    for k, (p, _) in kinds.items():
        q = F.col(f"q_{k}")
        lens[f"own_{k}"] = F.when(q, sizes(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).otherwise(none)
        lens[f"gap_{k}"] = F.when(q, sizes(F.split("text", p, -1))).otherwise(none)
        if k == "assign":
            lens["val_assign"] = F.when(q, sizes(F.regexp_extract_all("text", F.lit(p), F.lit(2)))).otherwise(none)
    d = d.withColumns(lens).drop("text", *[f"q_{k}" for k in kinds])
    # the last gap lies behind the last match
    both = lambda k: F.transform(f"own_{k}", lambda n, i: n + F.col(f"gap_{k}")[i])
    d = d.withColumns({f"at_{k}": _starts(both(k)) for k in kinds})
    start = lambda k, i: F.col(f"at_{k}")[i] + F.col(f"gap_{k}")[i]
    every = lambda k: F.transform(f"own_{k}", lambda n, i: F.struct(start(k, i).alias("s"), F.lit(KINDS.index(k)).alias("k"), (start(k, i) + n).alias("e")))
    spans = {k: every(k) for k in kinds}
    spans["assign"] = F.filter(spans["assign"], lambda _, i: F.col("val_assign")[i] >= 8)
    return d.withColumns(spans).drop(*lens, *[f"at_{k}" for k in kinds])


def _found(docs: DataFrame) -> DataFrame:
    """_row, doc_id, base and weak spans of every row; the text is left behind."""
    text, low = F.col("text"), F.lower("text")
    some = lambda k: reduce(lambda a, w: a | low.contains(w), WORDS[k], F.lit(False))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("_row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string")))
    return _with_spans(d, {
        "assign": (ASSIGN, some("assign")), "access": (ACCESS, text.contains("AKIA")), "hex": (HEX, text.rlike(HEX)),
        "ident": (IDENT, some("ident") & text.rlike(IDENT)), "key": (KEY, text.rlike(KEY)), "endpoint": (ENDPOINT, some("endpoint") & text.rlike(ENDPOINT))})


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans(docs: DataFrame, window: int = WINDOW, ids: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, base and linked, both array<struct<s, k, e>> (code points, e exclusive; k: index in KINDS).
    ``ids``: base kinds that count as identifiers for keys."""
    f = keep(_found(docs).withColumn("base", F.concat("assign", "access", "hex")).withColumn("weak", F.concat("ident", "key", "endpoint")).drop(*KINDS))
    none = F.slice("base", 1, 0)
    # a weak span within or across a base span says the same again
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
    f = f.withColumn("weak", F.when((F.size("weak") > 0) & (F.size("base") > 0), free).otherwise(F.col("weak")))
    key = KINDS.index("key")
    is_part = lambda x: x["k"].isin(KINDS.index("ident"), KINDS.index("endpoint"))
    is_id = lambda x: x["k"].isin(*[KINDS.index(k) for k in ids]) if ids else F.lit(False)
    has_key = F.exists("weak", lambda x: x["k"] == key)
    could = F.exists("weak", is_part) & ((F.size("base") > 0) | has_key) | has_key & F.exists("base", is_id)
    rows = f.where(could).dropDuplicates(["_row"]).select("_row", F.explode(F.concat("base", "weak")).alias("x")).select("_row", "x", is_part(F.col("x")).alias("part"))
    s, e = F.col("x.s"), F.col("x.e")
    cell = lambda c: F.floor(c / window)
    asks = rows.where(F.col("x.k") >= 3).withColumn("cell", F.explode(F.sequence(cell(s - window), cell(e + window))))
    gives = rows.select(F.col("_row").alias("row2"), s.alias("s2"), e.alias("e2"), F.col("part").alias("part2"), is_id(F.col("x")).alias("id2"), F.explode(F.sequence(cell(s), cell(e))).alias("cell2"))
    near = (F.col("s2") <= e + window) & (F.col("e2") >= s - window)
    hit = asks.join(gives, (F.col("_row") == F.col("row2")) & (F.col("cell") == F.col("cell2")) & ((F.col("part") != F.col("part2")) | (F.col("x.k") == key) & F.col("id2")) & near, "left_semi")
    linked = hit.groupBy("_row").agg(F.collect_set("x").alias("got"))
    some = f.where(could).join(linked, "_row", "left").select("doc_id", "base", F.coalesce("got", none).alias("linked"))
    return some.unionByName(f.where(~F.coalesce(could, F.lit(False))).select("doc_id", "base", none.alias("linked")))


def digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.concat("base", "linked")).alias("spans"))
