"""Spelling variants: words that differ by one character, found by a frontier of states that walks tries kept as tables.

A trie is an edge table spread over the cluster: a row per node with the steps that lead on, or, where at most LEAF words are left below,
with those words. The edges carry two characters, so that an edit is only tried where the word's own next character follows. There is one trie per word length and direction (words as written, and reversed), and it starts at half the words' length:
whichever way one edit splits two words, the longer half is the same in both, and is a prefix in one of the two directions. So the crowded
upper levels, where every word meets every other, are not walked, and the walk finds every pair all the same.

The frontier is a table of states (word, position, node, edits). It starts at the node of the word's own half, in the trie of its length (for
replaced characters) and in that of the next (for inserted ones; a deletion is an insertion seen from the other word). Level by level it is
joined with the nodes of that level: a state without an edit follows its own character, or any other for one edit; a state with an edit goes
on along its own characters only. At a leaf the words below are held against the rest, and those at one edit are neighbours. Edits are put at
the first place where two words differ, a character is only replaced by a later one, and a pair is taken in reverse only if its shared start
is too short for the other direction, so each pair comes once; it is then told of both words. Joins are on (direction, length, prefix), inner ones that adaptive execution splits where a prefix is crowded, and a
node has at most one row, so that no join multiplies rows.

Words are counted over all texts before anything else; neighbours are gathered per word by partial sums. Chains of forms are followed by
doubling.

Defined results: null and empty texts have no words; a null id counts as empty in the hash; repeated rows count as often as they stand;
extra columns are not read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, store

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST, TWICE, RATIO, EVERY = 7, 2, 10, 31
#: words that a leaf of a trie holds at most
LEAF = 24
#: ends a word in a trie, so that none is the beginning of another
END = "\n"


def words(docs: DataFrame, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """word, n: the words of at least ``least`` characters that occur ``twice`` or more, after the deletions that the hash asks for."""
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(LETTERS.replace("A-Z", "") + f"{{{least},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    found = runs.select(F.when(h % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= twice)


def _node(length, level, word):
    """The prefix at ``level`` below the start of a trie."""
    return F.substring(word, F.lit(1), F.floor(length / 2).cast("int") + level)


def _tries(ways: DataFrame, leaf: int) -> list[tuple[DataFrame, DataFrame]]:
    """(inner nodes, leaves) of each level, from rows (rev, word, n): rev, len, node, then steps (the next two characters of the words
    below: no more than the letters there are, squared) or words (array<struct<t, tn>>)."""
    rows = ways.select("rev", F.length("word").alias("len"), F.concat("word", F.lit(END)).alias("t"), F.col("n").alias("tn"))
    levels, key = [], ["rev", "len", "node"]
    while True:
        here = rows.withColumn("node", _node(F.col("len"), len(levels), F.col("t")))
        crowded = store(here.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > leaf).drop("size"))
        below = here.join(crowded, key, "left_anti").groupBy(key).agg(F.collect_list(F.struct("t", "tn")).alias("words"))
        if crowded.isEmpty():
            return [*levels, (None, store(below))]
        rows = store(here.join(crowded, key, "left_semi"))
        steps = rows.groupBy(key).agg(F.collect_set(F.substring(F.col("t"), F.length("node") + 1, F.lit(2))).alias("steps"))
        levels.append((store(steps), store(below)))
        rows = rows.drop("node")


def neighbours(counted: DataFrame, leaf: int = LEAF) -> DataFrame:
    """word, near, near_n: every word of ``counted`` (word, n; a table) with each word at exactly one edit, once."""
    ways = counted.select(F.lit(False).alias("rev"), "word", "n").unionByName(counted.select(F.lit(True).alias("rev"), F.reverse("word").alias("word"), "n"))
    tries = _tries(ways, leaf)
    own, half = F.length("word"), lambda n: F.floor(n / 2).cast("int")
    first = lambda more: ways.select("rev", (own + more).alias("len"), F.concat("word", F.lit(END)).alias("w"), F.col("n").alias("wn"), half(own + more).alias("pos"),
                                     F.substring(F.col("word"), F.lit(1), half(own + more)).alias("node"), F.lit(0).alias("edits"))
    states, key, found = first(0).unionByName(first(1)), ["rev", "len", "node"], []
    insert = F.col("len") == F.length("w")  # w has its END
    for inner, leaves in tries:
        at = states.join(leaves, key).select("*", F.explode("words").alias("x")).select("rev", "len", "w", "wn", "pos", "node", "edits", "x.t", "x.tn")
        rest = F.substring(F.col("t"), F.length("node") + 1, F.length("t")) == F.substring(F.col("w"), F.col("pos") + 1, F.length("w"))
        hit = at.where((insert | (F.col("t") > F.col("w"))) & ((F.col("edits") == 0) | rest)).where(F.levenshtein("w", "t", 1) == 1)
        # seen from behind, only pairs whose shared start is too short for the other direction; words as written are the reverse of t and w
        plain = lambda c: F.when(F.col("rev"), F.reverse(F.substring(F.col(c), F.lit(1), F.length(c) - 1))).otherwise(F.substring(F.col(c), F.lit(1), F.length(c) - 1))
        hit = hit.select("rev", "len", plain("w").alias("w"), "wn", plain("t").alias("t"), "tn")
        start = lambda c: F.substring(F.col(c), F.lit(1), half(F.col("len")))
        hit = hit.where(~F.col("rev") | (start("w") != start("t")))
        found.append(hit.select(F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(n).alias("near_n")) for x, y, n in (("w", "t", "tn"), ("t", "w", "wn"))])).alias("x")).select("x.*"))
        if inner is None:
            break
        mine, after = (F.substring(F.col("w"), F.col("pos") + i, F.lit(1)) for i in (1, 2))
        char, then = lambda x: F.substring(x, 1, 1), lambda x: F.substring(x, 2, 1)
        on = lambda c, pos, edits: F.struct(c.alias("c"), pos.alias("pos"), edits.alias("edits"))
        own_way = F.when(F.exists("steps", lambda x: (char(x) == mine) & ((F.col("edits") == 0) | (then(x) == after))), F.array(on(mine, F.col("pos") + 1, F.col("edits"))))
        # another character: put into the word, or in place of its own; what follows it must be the word's own again
        other = F.filter("steps", lambda x: (char(x) != END) & F.when(insert, (char(x) != mine) & (then(x) == mine)).otherwise((mine != END) & (char(x) > mine) & (then(x) == after)))
        edit = F.transform(other, lambda x: on(char(x), F.col("pos") + F.when(insert, 0).otherwise(1), F.lit(1)))
        none = F.array().cast("array<struct<c:string,pos:int,edits:int>>")
        ways_on = F.concat(F.coalesce(own_way, none), F.when(F.col("edits") == 0, edit).otherwise(none))
        at = states.join(inner, key).select("rev", "len", "w", "wn", "node", F.explode(ways_on).alias("x"))
        states = store(at.select("rev", "len", "w", "wn", F.col("x.pos").alias("pos"), F.concat("node", "x.c").alias("node"), F.col("x.edits").alias("edits")))
    return reduce(DataFrame.unionByName, found)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain that starts at each word of ``forms`` (word, form)."""
    at = store(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = store(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def variants(docs: DataFrame, least: int = LEAST, twice: int = TWICE, ratio: int = RATIO, leaf: int = LEAF) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    counted = store(words(docs, least, twice))
    near = neighbours(counted, leaf).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = counted.join(near, "word", "left")
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near"))
    known = store(known.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")))
    return known.join(roots(known.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS x FROM r GROUP BY ALL),
b AS (SELECT id, run, k, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM d),
c AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, y: list_reduce(list_prepend(xor(a, y), range(0, 8)), lambda v, _: xor(v >> 1, 3988292384 * (v & 1))))) AS h FROM b),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM c) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
e AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word, y.word AS near, y.n AS near_n FROM e x JOIN e y ON x.s = y.s AND x.i = y.i AND x.word <> y.word
      UNION SELECT x.word, y.word, y.n FROM w x JOIN e y ON x.word = y.s
      UNION SELECT x.word, y.word, y.n FROM e x JOIN w y ON x.s = y.word),
g AS (SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS best FROM p GROUP BY word),
f AS (SELECT w.word, CASE WHEN -best.less >= 10 * n THEN best.near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n FROM w LEFT JOIN g ON w.word = g.word),
t AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.further = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON f.word = t.word AND t.further IS NULL
"""
