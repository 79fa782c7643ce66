"""Keyword retrieval for a table of questions, and counting questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline import fixed
from wardline.functions import text as X
from wardline.session import cut, row_bound, small_lookup, spread

HOT_MIN = 10_000        # a key is never hot below this many chunks
HOT_SHARE = 0.001       # ... nor below this share of all chunks, which bounds the number of hot keys
HOT_ASKS = 100          # ... nor if no more tasks than this ask for it: its postings meet at most so many
BROADCAST_KEYS = 500_000  # question keys up to this number travel to every task


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = fixed.TOP_K, id_col: str = "question_id",
             col: str = "question", hot_min: int = HOT_MIN, hot_share: float = HOT_SHARE, hot_asks: int = HOT_ASKS) -> DataFrame:
    """The best-scoring chunks of each question: ``question_id, chunk_id, score, rank``.

    The score is the number of distinct question tokens a chunk holds (long tokens match on their first letters). Only
    chunks with the best score above zero are kept, at most ``k``, by chunk id.

    ``chunks`` has ``chunk_id, content`` and may have ``side`` and ``unit``; ``questions`` may have ``side`` (only chunks
    of that side are searched), ``sees_all`` and ``units`` (which units the asker may read).

    A token that is in very many chunks must not be joined to all of them for every question. Keys are split by how
    many chunks hold them. *Rare* keys are joined through their postings, and each candidate brings the hot keys of its
    chunk along, so its score is complete. Chunks that share only *hot* keys with a question are covered by groups: all
    chunks of one unit with the same set of hot keys score alike, so a group stands for them with its first ``k`` ids.
    A group is only looked at through keys a better answer must contain: if some candidate already scores s of m tokens,
    a chunk as good holds one of the m-s+1 rarest tokens. All steps are equality joins on pre-aggregated sides; equal
    questions are answered once."""
    q0 = questions
    q0 = q0 if "side" in q0.columns else q0.withColumn("side", F.lit("all"))
    q0 = q0 if "sees_all" in q0.columns else q0.withColumn("sees_all", F.lit(True)).withColumn("units", F.array().cast("array<string>"))
    c0 = chunks.filter("content is not null")
    c0 = c0 if "side" in c0.columns else c0.withColumn("side", F.lit("all"))
    c0 = c0 if "unit" in c0.columns else c0.withColumn("unit", F.lit(None).cast("string"))

    # questions with equal keys of readers with equal rights are one task: only the keys decide the score
    who = F.struct("side", "sees_all", F.array_sort("units").alias("units"))
    asked = q0.select(id_col, F.array_sort(F.transform(X.query_tokens(F.col(col)), lambda t: X.match_key(t))).alias("keys"), who.alias("who"))
    asked = asked.filter(F.size("keys") > 0).withColumn("_same", F.sha2(F.to_json(F.struct("who", "keys")), 256))
    tasks = cut(asked.groupBy("_same").agg(F.any_value("who").alias("who"), F.any_value("keys").alias("keys")).withColumn("task", F.monotonically_increasing_id()))
    wanted = tasks.select("task", F.col("who.side").alias("side"), F.col("who.sees_all").alias("sees_all"),
                          F.col("who.units").alias("units"), F.size("keys").alias("m"), F.explode("keys").alias("key"))

    # chunks keep only the keys that are asked for; the empty key, which no token has, keeps the others' rows for the count
    vocabulary = cut(wanted.groupBy("side", "key").agg(F.count_distinct("task").alias("asks")))
    found_in = spread(c0.select("side", "unit", "chunk_id", "content")).select(
        "side", "unit", "chunk_id", X.content_keys(F.col("content")).alias("_keys"), F.monotonically_increasing_id().alias("_row")).select(
        "side", "unit", "chunk_id", "_row", F.explode(F.array_append("_keys", F.lit(""))).alias("key"))
    found_in = found_in.join(small_lookup(vocabulary.select("side", "key", F.lit(True).alias("_asked")), BROADCAST_KEYS), ["side", "key"], "left").filter("_asked or key = ''")
    posted = cut(found_in.groupBy("side", "unit", "chunk_id", "_row").agg(F.collect_list(F.nullif("key", F.lit(""))).alias("keys")).drop("_row"))
    df_ = posted.select("side", F.explode("keys").alias("key")).groupBy("side", "key").agg(F.count(F.lit(1)).alias("df"))
    threshold = F.greatest(F.lit(hot_min), (posted.agg(F.count(F.lit(1))).scalar() * hot_share).cast("long"))
    # one row per question key, read by every step
    keyed = cut(df_.join(vocabulary, ["side", "key"]).select("side", "key", "df", (F.col("df") > threshold).alias("wide"), ((F.col("df") > threshold) & (F.col("asks") > hot_asks)).alias("hot")))
    hot_list = keyed.filter("hot").groupBy("side").agg(F.collect_set("key").alias("h")).agg(F.map_from_entries(F.collect_list(F.struct("side", "h"))).alias("m"))
    mine = F.try_element_at(hot_list.scalar(), F.col("side"))
    held = posted.withColumn("hot_keys", F.coalesce(F.array_intersect("keys", mine), F.array().cast("array<string>")))

    # question side: its rare keys, its hot keys (rarest first; equal keys count once per token)
    ranked = cut(wanted.join(keyed, ["side", "key"]))
    hots = ranked.filter("hot").groupBy("task").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("_h"))
    hots = hots.select("task", F.transform("_h", lambda x: x["key"]).alias("hot_q"))
    rare = cut(ranked.filter("not hot").groupBy("task", "side", "sees_all", "units", "key", "wide").agg(F.count(F.lit(1)).alias("w")))
    visible = F.col("sees_all") | F.array_contains("units", F.col("unit"))
    hot_score = F.coalesce(F.size(F.filter("hot_q", lambda x: F.array_contains("hot_keys", x))), F.lit(0))

    # candidates by their rare keys alone; keys that few tasks ask for meet their postings inside the tasks that read them
    top = W.partitionBy("task").orderBy(F.desc("score"), "chunk_id")
    if row_bound(rare, BROADCAST_KEYS) is None:
        by_rare = _joined_by_key(posted, held, rare, tasks, hots, visible, hot_score)
    else:
        # all rows of a chunk in one task: its score for every question is complete there, and only the best k of a task and question leave it
        same = W.partitionBy("chunk_id", "side")
        here = held.repartition("chunk_id").withColumn("all", F.collect_set(F.struct("unit", "hot_keys")).over(same))
        here = here.select("chunk_id", "side", "all", "unit", F.explode("keys").alias("key"))
        hit = here.join(F.broadcast(rare.join(hots, "task", "left")), ["side", "key"]).filter(F.coalesce(visible, F.lit(False)))
        seen = F.filter("all", lambda x: F.coalesce(F.col("sees_all") | F.array_contains("units", x["unit"]), F.lit(False)))
        gains = F.array_max(F.transform(seen, lambda x: F.size(F.filter("hot_q", lambda y: F.array_contains(x["hot_keys"], y)))))
        by_rare = hit.select("task", "chunk_id", "w", F.when(F.col("hot_q").isNull() | F.col("chunk_id").isNull(), 0).otherwise(gains).alias("_gain")).groupBy("task", "chunk_id").agg(
            (F.sum("w") + F.max("_gain")).alias("score"))
    by_rare = cut(by_rare.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).drop("rank"))

    # groups of chunks with the same hot keys, with their first k ids
    first = W.partitionBy("side", "unit", "hot_keys").orderBy("chunk_id")
    groups = (held.filter(F.size("hot_keys") > 0).select("side", "unit", F.array_sort("hot_keys").alias("hot_keys"), "chunk_id")
              .withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k)
              .groupBy("side", "unit", "hot_keys").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids")))
    best = by_rare.groupBy("task").agg(F.max("score").alias("best"))
    probe = (tasks.select("task", F.col("who.side").alias("side"), F.col("who.sees_all").alias("sees_all"), F.col("who.units").alias("units"),
                          F.size("keys").alias("m")).join(hots, "task").join(best, "task", "left"))
    # a chunk scoring at least `need` holds one of the m-need+1 rarest tokens; tokens without any posting come first
    need = F.greatest(F.coalesce("best", F.lit(1)), F.lit(1))
    cold = F.col("m") - F.size("hot_q")
    probe = probe.withColumn("need", need).filter(F.col("need") <= F.size("hot_q")).withColumn(
        "_keys", F.array_distinct(F.slice("hot_q", 1, F.greatest(F.col("m") - F.col("need") + 1 - cold, F.lit(0)))))
    probe = probe.filter(F.size("_keys") > 0)
    pk = probe.select("task", "side", "sees_all", "units", "need", "hot_q", F.explode("_keys").alias("key"))
    gk = groups.select("side", "unit", "hot_keys", "ids", F.explode("hot_keys").alias("key"))
    by_group = gk.join(pk, ["side", "key"]).filter(F.coalesce(visible, F.lit(False))).withColumn("score", hot_score)
    by_group = by_group.filter(F.col("score") >= F.col("need"))
    # only groups with the task's best score go on to their ids
    by_group = by_group.withColumn("_r", F.rank().over(W.partitionBy("task").orderBy(F.desc("score")))).filter("_r = 1").select("task", "score", F.explode("ids").alias("chunk_id"))

    found = by_rare.select("task", "chunk_id", F.col("score").cast("int").alias("score")).union(
        by_group.select("task", "chunk_id", F.col("score").cast("int").alias("score")))
    found = found.groupBy("task", "chunk_id").agg(F.max("score").alias("score"))
    found = (found.withColumn("_r", F.rank().over(W.partitionBy("task").orderBy(F.desc("score")))).filter("_r = 1")
             .withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k))
    return asked.select(id_col, "_same").join(tasks.select("_same", "task"), "_same").join(found, "task").select(id_col, "chunk_id", "score", "rank")


def _joined_by_key(posted: DataFrame, held: DataFrame, rare: DataFrame, tasks: DataFrame, hots: DataFrame, visible: Column, hot_score: Column) -> DataFrame:
    """Scores of candidates (task, chunk_id, score) where the keys of all tasks are too many to travel to every task."""
    postings = posted.select("side", "unit", "chunk_id", F.explode("keys").alias("key"))
    narrow = rare.filter("not wide")
    hit = (postings.join(narrow.select("side", "key").distinct(), ["side", "key"], "left_semi").join(narrow, ["side", "key"])
           .unionByName(postings.join(small_lookup(rare.filter("wide"), BROADCAST_KEYS), ["side", "key"])))
    hit = hit.filter(F.coalesce(visible, F.lit(False)))
    by_rare = hit.groupBy("task", "chunk_id").agg(F.sum("w").alias("score"))
    if row_bound(hots, 0) is not None:
        return by_rare
    # hot keys are looked up only for candidates that may still be the best: no other can gain more than its task's hot keys
    by_rare = cut(by_rare)
    reach = by_rare.groupBy("task").agg(F.max("score").alias("_most")).join(hots, "task", "left")
    by_rare = by_rare.join(reach, "task").filter(F.col("score") + F.coalesce(F.size("hot_q"), F.lit(0)) >= F.col("_most"))
    sure, open_ = by_rare.filter("hot_q is null"), by_rare.filter("hot_q is not null")
    lists = tasks.select("task", F.col("who.side").alias("side"), F.col("who.sees_all").alias("sees_all"), F.col("who.units").alias("units"))
    bonus = (open_.join(lists, "task").join(held.filter(F.size("hot_keys") > 0).select("side", "unit", "chunk_id", "hot_keys"), ["side", "chunk_id"], "left")
             .withColumn("_bonus", F.when(F.coalesce(visible, F.lit(False)), hot_score).otherwise(0))
             .groupBy("task", "chunk_id").agg((F.any_value("score") + F.max("_bonus")).alias("score")))
    return sure.select("task", "chunk_id", "score").unionByName(bonus)


def count_entities(questions: DataFrame, chunks: DataFrame, id_col: str = "question_id", col: str = "question") -> DataFrame:
    """Counting questions: distinct patient names over the records their asker may see, within a unit if the question
    names one. Gives ``question_id, unit_scope, entities, matched_rows``.

    Records are read once and reduced to a row per unit, name and units said; what follows reads those. They become (unit,
    name) pairs and then *sets of units a name occurs in*, which are few, before they meet the questions; distinct names are
    never counted twice because a name has exactly one such set."""
    q0 = questions
    q0 = q0 if "sees_all" in q0.columns else q0.withColumn("sees_all", F.lit(True)).withColumn("units", F.array().cast("array<string>"))
    c0 = chunks.filter("content is not null")
    c0 = c0 if "unit" in c0.columns else c0.withColumn("unit", F.lit(None).cast("string"))
    rec = c0.select(
        "unit", "chunk_id",
        F.nullif(F.regexp_extract("content", "(?dU)" + fixed.NAME_IN_RECORD, 1), F.lit("")).alias("name"),
        F.array_distinct(F.regexp_extract_all("content", F.lit(fixed.UNIT_IN_RECORD), F.lit(1))).alias("named_units"),
        F.array_distinct(F.regexp_extract_all("content", F.lit(" in ([A-Za-z]+),"), F.lit(1))).alias("in_units"))
    rec = cut(rec.groupBy("unit", "name", "named_units", "in_units").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id")))

    # the unit a question asks about: the first (by chunk id) unit of a visible record whose word is in the question
    units = rec.select("unit", "first_id", "last_id", F.explode("named_units").alias("word")).groupBy("unit", F.lower("word").alias("low")).agg(
        F.min("first_id").alias("first_id"), F.max(F.struct(F.col("last_id").alias("chunk_id"), "word")).alias("_last"))
    said = q0.select(id_col, "sees_all", "units", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower(col), F.lit(r"(?U)\w+"), F.lit(0)))).alias("low"))
    visible = F.coalesce(F.col("sees_all") | F.array_contains("units", F.col("unit")), F.lit(False))
    named = said.join(units, "low").filter(visible).groupBy(id_col, "low").agg(
        F.min("first_id").alias("first_id"), F.max("_last").alias("_last"))
    scope = named.groupBy(id_col).agg(F.min(F.struct("first_id", "_last")).alias("_s")).select(
        id_col, F.col("_s._last.word").alias("unit_scope"))
    q1 = q0.select(id_col, "sees_all", F.array_sort("units").alias("units")).join(scope, id_col, "left")
    jobs = q1.select("sees_all", "units", "unit_scope").distinct()
    jobs = jobs.withColumn("job", F.sha2(F.to_json(F.struct("sees_all", "units", "unit_scope"), {"ignoreNullFields": "false"}), 256))

    # per scope word (null = any): rows per unit, and names by the set of units they occur in
    anyword = F.explode(F.array_union(F.array(F.lit(None).cast("string")), F.col("in_units")))
    cell = rec.select(F.coalesce("unit", F.lit("")).alias("u"), "name", "n", anyword.alias("word")).groupBy("word", "u", "name").agg(
        F.sum("n").alias("n"))
    rows = cell.groupBy("word", "u").agg(F.sum("n").alias("n"))
    sets = cell.filter("name is not null").groupBy("word", "name").agg(F.array_sort(F.collect_set("u")).alias("us")).groupBy("word", "us").agg(
        F.count(F.lit(1)).alias("names"))
    seen = F.col("sees_all") | F.array_contains("units", F.col("u"))
    same = F.col("unit_scope").eqNullSafe(F.col("word"))
    n_rows = jobs.join(rows, same).filter(seen).groupBy("job").agg(F.sum("n").alias("matched_rows"))
    n_names = jobs.join(sets, same).filter(F.col("sees_all") | F.arrays_overlap("units", "us")).groupBy("job").agg(
        F.sum("names").alias("entities"))
    done = jobs.join(n_rows, "job", "left").join(n_names, "job", "left")
    out = q1.alias("q").join(done.alias("d"), (F.col("q.sees_all") == F.col("d.sees_all")) & (F.col("q.units") == F.col("d.units"))
                             & F.col("q.unit_scope").eqNullSafe(F.col("d.unit_scope")), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("q." + id_col), F.col("q.unit_scope"), F.coalesce("entities", zero).alias("entities"),
                      F.coalesce("matched_rows", zero).alias("matched_rows"))


def count_answer(entities, unit_scope):
    """The sentence that answers a counting question."""
    s = F.when(entities == 1, F.lit("")).otherwise(F.lit("s"))
    where = F.coalesce(F.concat(F.lit(" in "), unit_scope), F.lit(""))
    return F.concat(entities.cast("string"), F.lit(" patient"), s, F.lit(" with encounters on record"), where, F.lit(fixed.COUNT_SUFFIX))


def counted_rows(questions: DataFrame, counts: DataFrame, chunks: DataFrame, id_col: str = "question_id") -> DataFrame:
    """The records behind each count, as rows (question_id, chunk_id). A list of them per question would have no bound,
    so they stay a relation; write it partitioned when an audit needs it."""
    rec = chunks.filter("content is not null").select(
        "chunk_id", "unit", F.explode(F.array_union(F.array(F.lit(None).cast("string")), F.array_distinct(
            F.regexp_extract_all("content", F.lit(" in ([A-Za-z]+),"), F.lit(1))))).alias("word"))
    q = questions.select(id_col, "sees_all", "units").join(counts.select(id_col, "unit_scope"), id_col)
    seen = F.coalesce(F.col("sees_all") | F.array_contains("units", F.col("unit")), F.lit(False))
    return q.join(rec, F.col("unit_scope").eqNullSafe(F.col("word"))).filter(seen).select(id_col, "chunk_id")
