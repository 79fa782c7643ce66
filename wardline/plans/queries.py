"""Every operator as a query over the driver's tables. Each entry takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import fixed
from wardline.functions import parse as P
from wardline.functions import text as X
from wardline.operators import audit, chain, chunks, gold, grounding, lineage, monitor, names, policy, quality, ratelimit, retrieve, route, tags, vector, vector_index
from wardline.sources import bindings as B
from wardline.sources import tables as S
from wardline.session import cut, scratch, stored
from wardline.streaming import limits, medallion

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def ts_text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def joined(c, alias: str):
    return F.array_join(F.col(c) if isinstance(c, str) else c, ",").alias(alias)


# ------------------------------------------------------------------ parse, quality, merge
@query
def parse_encounters(spark: SparkSession, sf: str) -> DataFrame:
    return P.parse_json(B.raw_encounters(spark, sf), P.ENCOUNTER_PATHS)


@query
def parse_labs(spark, sf):
    return P.parse_json(B.raw_labs(spark, sf), P.LAB_PATHS)


@query
def parse_beds_typed(spark, sf):
    return P.parse_json(B.raw_beds(spark, sf), P.BED_PATHS, P.BED_CASTS)


@query
def expect_or_drop(spark, sf):
    e = parse_encounters(spark, sf)
    good, dropped, _ = quality.expect_or_drop(e, {"valid_encounter_id": F.col("encounter_id").isNotNull(), "open_or_final": F.col("encounter_class") != "P"})
    return good.select("encounter_id", F.lit("kept").alias("outcome")).unionByName(
        dropped.select("encounter_id", F.array_join("failed_rules", "+").alias("outcome"))).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("rows"), F.count("encounter_id").alias("with_id"))


@query
def dedupe_latest(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    d = quality.dedupe(li, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_extendedprice")])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", ts_text("l_shipdate"))


@query
def flag_results(spark, sf):
    f = gold.flag_results(B.labs(spark, sf), gold.reference_ranges(spark))
    return f.groupBy("test_code", "computed_flag").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("result_value").cast("long")).alias("value_sum"))


@query
def merge_insert_missing(spark, sf):
    target = B.reader_staff(spark, sf)
    source = B.table(spark, sf, "events").select(F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.org")).alias("staff_email"),
                                                 F.when(F.col("user_id") % 2 == 0, "ICU").otherwise("ED").alias("assigned_unit")).distinct()
    return target.unionByName(S.merge_insert_missing(target, source, ["staff_email", "assigned_unit"]))


@query
def ensure_column(spark, sf):
    c = S.ensure_column(B.table(spark, sf, "customer"), "mrn", "string", after="c_name")
    return c.select(*[x for x in c.columns if x in ("c_custkey", "c_name", "mrn")], F.lit(c.columns.index("mrn")).alias("position"))


@query
def load_profile(spark, sf):
    return S.profile_load(B.encounters(spark, sf), ["encounter_class", "unit"], "period_start", "mrn")


@query
def table_counts(spark, sf):
    return S.table_counts({n: B.table(spark, sf, n) for n in ["customer", "orders", "lineitem", "events"]})


# ------------------------------------------------------------------ gold, chunks, index
@query
def gold_join(spark, sf):
    g = gold.join_child_to_parent(B.encounters(spark, sf), B.labs(spark, sf))
    return g.select("encounter_id", "mrn", "unit", "lab_encounter_id", "test_code", "result_value", "result_flag", "observed_at")


@query
def latest_by_unit(spark, sf):
    b = B.beds(spark, sf)
    return gold.latest_by(b, ["unit"], F.struct("as_of", "event_id"), ["beds_total", "beds_available", "as_of"])


def phi_chunks(spark, sf):
    return chunks.chunk_parents(gold.join_child_to_parent(chunks.distinct_parents(B.encounters(spark, sf)), B.labs(spark, sf), gather=chunks.LAB_FIELDS))


def general_chunks(spark, sf):
    return chunks.chunk_general(B.facilities(spark, sf), B.policies(spark, sf), latest_by_unit(spark, sf))


@query
def chunk_parents(spark, sf):
    return phi_chunks(spark, sf)


@query
def chunk_general(spark, sf):
    return general_chunks(spark, sf)


@query
def null_content(spark, sf):
    return chunks.null_content(general_chunks(spark, sf))


def _two_versions(spark, sf):
    d = B.table(spark, sf, "documents")
    old = d.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("chunk_id"), "text")
    new = d.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" (v2)"))).otherwise(F.col("text")).alias("text"))
    return old, new


@query
def snapshot_diff(spark, sf):
    old, new = _two_versions(spark, sf)
    return chunks.sync_index(new, old, "chunk_id", "text")


@query
def index_after_sync(spark, sf):
    old, new = _two_versions(spark, sf)
    return chunks.apply_sync(new, old, "chunk_id", "text").select("chunk_id", F.md5("text").alias("text_md5"))


@query
def index_stored_by_bucket(spark, sf):
    """An index kept by buckets with their digests, brought up to a source of which a part changed: only those buckets are rewritten."""
    old, new = _two_versions(spark, sf)
    path = scratch(spark)
    chunks.store_index(old, path, "chunk_id", "text", 64)
    chunks.store_index(old.filter("chunk_id % 7 <> 1").unionByName(new.filter("chunk_id % 7 = 0")), path, "chunk_id", "text", 64)
    chunks.store_index(new, path, "chunk_id", "text", 64)
    return chunks.read_index(spark, path).select("chunk_id", F.md5("text").alias("text_md5"))


# ------------------------------------------------------------------ monitoring
@query
def routing_mix_daily(spark, sf):
    return monitor.routing_mix_daily(B.chat_log(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query
def grounding_daily(spark, sf):
    return monitor.grounding_daily(B.chat_log(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query
def latency_hourly(spark, sf):
    v = monitor.latency_hourly(B.chat_log(spark, sf))
    return v.select(ts_text("hour"), *[c for c in v.columns if c != "hour"])


@query
def usage_by_day(spark, sf):
    u = ratelimit.usage_by(B.chat_log(spark, sf), ["user_email", "model"], "event_time", "day", limit=2)
    return u.select("user_email", "model", ts_text("period"), "requests", "over_limit")


@query
def invariant_phi_external(spark, sf):
    return audit.invariant_counts(B.chat_log(spark, sf), B.EXTERNAL)


@query
def recent_requests(spark, sf):
    return audit.recent(B.chat_log(spark, sf), "event_time", 20, "event_id").select("event_id", "user_email", "status", "path", "model", "matched_chunks", "generate_s")


# ------------------------------------------------------------------ governance
TABLE_SCHEMAS = {"customer": "clinical", "orders": "clinical", "supplier": "operational", "documents": "clinical", "conversations": "operational"}


def _labelled(spark, sf):
    out = None
    for t, s in TABLE_SCHEMAS.items():
        one = tags.classify_columns(B.table(spark, sf, t), t, s)
        out = one if out is None else out.unionByName(one)
    return out


@query
def classify_columns(spark, sf):
    return _labelled(spark, sf).select("table_name", "column_name", "label", "strong")


@query
def label_tables(spark, sf):
    return tags.label_tables(_labelled(spark, sf))


def _old_tags(spark, sf):
    """Tags of an earlier run: one row per nation for a table that this run does not touch, and stale rows of two it does."""
    n = B.table(spark, sf, "nation")
    return n.select(F.when(F.col("n_regionkey") == 0, "customer").when(F.col("n_regionkey") == 1, "orders").otherwise("nation").alias("table_name"),
                    F.lower("n_name").alias("column_name"), F.when(F.col("n_nationkey") % 4 == 0, "unit_key").otherwise("classification").alias("tag_name"),
                    F.lit("pii").alias("tag_value"))


@query
def apply_tags(spark, sf):
    cols = _labelled(spark, sf)
    labels = tags.label_tables(cols)
    return tags.apply_tags(_old_tags(spark, sf), tags.column_tag_rows(cols, labels), labels.select("table_name"))


@query
def tag_listing(spark, sf):
    return tags.list_tags(apply_tags(spark, sf))


@query
def union_registry(spark, sf):
    c = B.table(spark, sf, "customer")
    tt = c.select(F.concat(F.lit("t"), F.col("c_nationkey")).alias("table_name"), F.lit("classification").alias("tag_name"),
                  F.when(F.col("c_mktsegment") == "BUILDING", "phi").otherwise("general").alias("tag_value"))
    s = B.table(spark, sf, "supplier")
    ct = s.select(F.concat(F.lit("t"), F.col("s_nationkey") + 10).alias("table_name"), F.lit("classification").alias("tag_name"),
                  F.when(F.col("s_acctbal") > 5000, "pii").otherwise("general").alias("tag_value"))
    r = tags.build_registry(tt, ct, tt, B.encounters(spark, sf))
    return r.phi.select(F.lit("sensitive").alias("kind"), F.col("table_name").alias("value")).unionByName(
        r.known.select(F.lit("known").alias("kind"), F.col("table_name").alias("value"))).unionByName(
        r.names.select(F.lit("name").alias("kind"), F.col("name").alias("value")))


@query
def unit_row_filter(spark, sf):
    e, g, s = B.encounters(spark, sf), B.groups(spark, sf), B.staff(spark, sf)
    return policy.filter_by_unit(e, "user2@example.org", "unit", g, s).select("encounter_id", "unit")


@query
def visible_rows(spark, sf):
    scopes = policy.reader_scopes(B.questions(spark, sf), B.groups(spark, sf), B.staff(spark, sf))
    return policy.visible_counts(B.encounters(spark, sf), "unit", scopes)


@query
def role_gate(spark, sf):
    g, x = B.groups(spark, sf), B.labs(spark, sf)
    seen = [policy.filter_by_role(x, f"user{i}@example.org", g).groupBy("test_code").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(f"user{i}").alias("reader"), "test_code", "rows") for i in (0, 3, 5)]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


@query
def mask_columns(spark, sf):
    g, e = B.groups(spark, sf), B.encounters(spark, sf)
    seen = [policy.mask(e, ["patient_name", "mrn"], f"user{i}@example.org", g).select(F.lit(f"user{i}").alias("reader"), "encounter_id", "patient_name", "mrn") for i in (0, 4)]
    return seen[0].unionByName(seen[1])


@query
def secure_dispatch(spark, sf):
    e, x, g, s = B.encounters(spark, sf), B.labs(spark, sf), B.groups(spark, sf), B.staff(spark, sf)
    tt = spark.createDataFrame([("enc", "classification", "phi"), ("enc", "row_scope", "unit"), ("lab", "classification", "phi"),
                                ("lab", "row_scope", "clinical"), ("fac", "classification", "general")], "table_name string, tag_name string, tag_value string")
    ct = spark.createDataFrame([("enc", "unit", "unit_key", "true")], "table_name string, column_name string, tag_name string, tag_value string")
    out = None
    for t, df in {"enc": e, "lab": x, "fac": B.facilities(spark, sf)}.items():
        for i in (0, 2, 5):
            one = policy.secure_view(df, t, f"user{i}@example.org", tt, ct, g, s).agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(t).alias("table_name"), F.lit(f"user{i}").alias("reader"), "rows")
            out = one if out is None else out.unionByName(one)
    return out


@query
def access_review(spark, sf):
    r = audit.access_review(B.access_reads(spark, sf), B.reader_staff(spark, sf), "clinical.")
    return r.select(ts_text("event_time"), "user_email", "table_name", "action_name")


@query
def access_review_not_in(spark, sf):
    s = B.reader_staff(spark, sf)
    r = audit.access_review(B.access_reads(spark, sf), s, "clinical.", null_aware=True)
    n = audit.access_review(B.access_reads(spark, sf), s.unionByName(s.select(F.lit(None).cast("string").alias("staff_email"), "assigned_unit")), "clinical.", null_aware=True)
    return r.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("clean").alias("staff"), "rows").unionByName(
        n.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("with_null").alias("staff"), "rows"))


@query
def touches(spark, sf):
    return audit.touches(B.access_reads(spark, sf), "clinical.", 50, "event_id").select(ts_text("event_time"), "event_id", "user_email", "table_name", "action_name")


# ------------------------------------------------------------------ text
@query
def identifiers_documents(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", joined(X.find_identifiers(F.col("text")), "kinds")).filter("kinds <> ''")


@query
def identifiers_conversations(spark, sf):
    c = B.table(spark, sf, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.size(X.find_identifiers(F.col("text"))) > 0).alias("flagged"))


@query
def screen_questions(spark, sf):
    q = B.questions(spark, sf)
    fired = X.fired_patterns(F.col("question"))
    return route.screen(q).select("question_id", "blocked_reason", joined(fired, "patterns"))


@query
def screen_documents(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", X.screen_reason(F.col("text")).alias("reason"), X.is_count_question(F.col("text")).alias("counts"))


def _registry(spark, sf):
    known = spark.createDataFrame([(t,) for t in B.PHI_TABLES + B.GENERAL_TABLES if t != "operational.policy_docs"], "table_name string")
    phi = spark.createDataFrame([(t,) for t in B.PHI_TABLES], "table_name string")
    return tags.Registry(phi, known, tags.known_names(B.encounters(spark, sf)))


@query
def classify_intents(spark, sf):
    return route.classify_intent(B.questions(spark, sf), _registry(spark, sf).names).select("question_id", "intent")


@query
def intents_conversations(spark, sf):
    c = B.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn", F.md5("text")).alias("question_id"), "text")
    return route.classify_intent(c, None, "question_id", "text").groupBy("intent").agg(F.count(F.lit(1)).alias("turns"))


@query
def route_questions(spark, sf):
    r = route.route(B.questions(spark, sf), _registry(spark, sf))
    return r.select("question_id", "intent", joined("tables", "tables"), "phi", "reason")


def _with_people(df, sf, id_col, col, every, before):
    """Every so many texts name a person of one, two or three words."""
    who = B.people_in_texts(df.sparkSession, sf)                # three rows
    k = F.col(id_col)
    out = df.join(F.broadcast(who), F.floor(k / every) % 3 == F.col("kind"), "left")
    return out.withColumn(col, F.when((k % every == 1) & F.col("person").isNotNull(), F.concat(F.col(col), F.lit(before), F.initcap("person"))).otherwise(F.col(col))).select(*df.columns)


@query
def leak_redirect(spark, sf):
    """Every fourth question names a person; misspelt names, which SQL can't tell, are left to the tests."""
    q = _with_people(B.questions(spark, sf), sf, "question_id", "question", 4, " Please tell ")
    r = route.redirect_leaks(route.route(q, _registry(spark, sf)), B.people(spark, sf).select("name").distinct(), fuzzy=False)
    return r.select("question_id", "phi", "reason", joined("flags", "flags"))


@query
def redact_errors(spark, sf):
    e = B.table(spark, sf, "events")
    msg = F.concat(F.lit("PermissionError: request "), F.col("event_id"), F.lit(" > Authorization: Bearer tok."), F.md5(F.col("event_id").cast("string")),
                   F.lit("-x_1 "), F.repeat(F.lit("detail "), (F.col("event_id") % 40).cast("int")))
    return e.select("event_id", P.redact(msg).alias("safe"))


@query
def refusals(spark, sf):
    e = B.table(spark, sf, "events")
    side = F.when(F.col("event_id") % 3 == 0, "input_guardrail").when(F.col("event_id") % 3 == 1, "output_guardrail").otherwise("usage")
    payload = F.concat(F.lit('{"'), side, F.lit('": [{"flagged": '), F.when(F.col("event_id") % 4 == 0, "false").otherwise("true"),
                       F.lit(', "categories": {"violent-crimes": '), F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"),
                       F.lit(', "'), F.col("event_type"), F.lit('": true, "pii": '), F.when(F.col("user_id") % 5 == 0, "true").otherwise("false"), F.lit("}}]}"))
    r = P.parse_refusals(e.select("event_id", payload.alias("payload")), "payload")
    return r.select("event_id", "side", "flagged", joined("categories", "categories"), "message")


@query
def classify_outcomes(spark, sf):
    e = B.table(spark, sf, "events")
    kind = (F.when(F.col("event_type") == "click", F.lit(None)).when(F.col("event_type") == "view", "guardrail")
            .when(F.col("event_type") == "signup", "permission").when(F.col("event_type") == "error", "read").otherwise("RuntimeError"))
    text = F.concat(F.when(F.col("event_id") % 3 == 0, "Invalid scope in request ").when(F.col("event_id") % 3 == 1, "INSUFFICIENT_PRIVILEGES ").otherwise("timeout "), F.col("event_id"))
    d = e.select("event_id", kind.alias("error_type"), text.alias("error_text"), (F.col("user_id") % 2 == 0).alias("phi"))
    return P.classify_outcome(d).select("event_id", "status", "message")


# ------------------------------------------------------------------ names
def _texts(spark, sf):
    d, c = B.table(spark, sf, "documents"), B.table(spark, sf, "conversations")
    w = X.words(F.col("text")).alias("w")
    return d.select(F.concat(F.lit("d"), "doc_id").alias("text_id"), w).unionByName(c.select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("text_id"), w))


@query
def name_scan_exact(spark, sf):
    """People of one to three words, looked up in documents and conversations."""
    nm, t = B.people(spark, sf).select("name").distinct(), _texts(spark, sf)
    sub = names.substring_hits(t, nm, "text_id", "w").withColumn("how", F.lit("substring"))
    part = names.part_hits(t, nm, "text_id", "w").withColumn("how", F.lit("part"))
    return sub.unionByName(part)


@query
def name_scan_fuzzy(spark, sf):
    return names.fuzzy_hits(_texts(spark, sf), B.people(spark, sf).select("name").distinct(), "text_id", "w")


@query
def customer_names_in_questions(spark, sf):
    q = B.questions(spark, sf)
    hits = names.raw_name_hits(q, tags.known_names(B.encounters(spark, sf)), "question_id", "question")
    return names.with_name_hit(q, hits, "question_id").select("question_id", "name_hit")


# ------------------------------------------------------------------ retrieval, records, prompts
@query
def retrieve_topk(spark, sf):
    q = B.questions(spark, sf)
    return retrieve.retrieve(q.select("question_id", "question"), phi_chunks(spark, sf).select("chunk_id", "content"))


@query
def retrieve_documents(spark, sf):
    """Benchmark items as questions against whole documents."""
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return retrieve.retrieve(q, d)


def _scoped(spark, sf):
    q = B.questions(spark, sf)
    return q.join(policy.reader_scopes(q, B.groups(spark, sf), B.staff(spark, sf)), "user_email")


@query
def retrieve_scoped(spark, sf):
    """Each reader searches only the records of their units."""
    return retrieve.retrieve(_scoped(spark, sf), phi_chunks(spark, sf).select("chunk_id", "unit", "content"))


@query
def count_entities(spark, sf):
    q = _scoped(spark, sf).filter(X.is_count_question(F.col("question")))
    c = retrieve.count_entities(q, phi_chunks(spark, sf))
    return c.select("question_id", "unit_scope", "entities", "matched_rows", retrieve.count_answer(F.col("entities"), F.col("unit_scope")).alias("answer"))


@query
def parse_records(spark, sf):
    p = P.parse_record_text(phi_chunks(spark, sf).select("chunk_id", "content"))
    return p.select("chunk_id", "parsed", "patient_name", "mrn", "encounter_class", "encounter_id", "period_start", "unit", "diagnosis_code",
                    F.coalesce(F.size("labs"), F.lit(0)).alias("n_labs"), F.element_at("labs", 1)["test"].alias("first_test"), F.element_at("labs", -1)["time"].alias("last_time"))


@query
def format_records(spark, sf):
    return P.format_record(phi_chunks(spark, sf).select("chunk_id", "content")).select("chunk_id", "markdown")


@query
def build_prompts(spark, sf):
    q = B.questions(spark, sf).withColumn("phi", F.lit(False))
    c = general_chunks(spark, sf)
    rec = grounding.records_of(retrieve.retrieve(q, c.select("chunk_id", "content")), c)
    return grounding.build_prompts(q, rec).select("question_id", "context", "prompt")


@query
def grounding_check(spark, sf):
    """Replies made from each order's own numbers (one in three states a wrong total) against its encounter text."""
    o = B.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    ans = o.select(F.concat(F.lit("enc-ENC-"), k).alias("question_id"), F.concat(
        F.lit("Encounter ENC-"), k, F.lit(" was on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" at 0:00, value "),
        F.when(k % 3 == 0, k + 77777).otherwise(F.lit(1)).cast("string"), F.lit(" (0"), F.col("o_custkey") + 8000001, F.lit(").")).alias("answer"))
    c = phi_chunks(spark, sf)
    rec = c.select(F.col("chunk_id").alias("question_id"), F.array("content").alias("records"))
    return grounding.check_grounded(ans, rec).select("question_id", joined("unsupported", "unsupported"), (F.col("shown") == F.col("answer")).alias("kept"))


@query
def block_leaks(spark, sf):
    """Documents as context and conversation-like text as replies, of which every tenth holds a phone number and every seventh a name."""
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("context"), F.upper("source").alias("answer"))
    d = d.withColumn("answer", F.when(F.col("question_id") % 10 == 0, F.concat(F.col("answer"), F.lit(" call 555-123-4567"))).otherwise(F.col("answer")))
    d = _with_people(d, sf, "question_id", "answer", 7, " asks ")
    return grounding.block_leaks(d, B.people(spark, sf).select("name").distinct(), context="context", answer="answer", fuzzy=False).select("question_id", "status", "message")


# ------------------------------------------------------------------ rate limit, chain, vectors, lineage
@query
def rate_limit(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return ratelimit.rate_limit(e, "user_id", "ts", "event_id", limit=2, window_seconds=86400).select("event_id", "user_id", "admitted")


def _chain_rows(spark, sf):
    log = B.chat_log(spark, sf)
    null = F.lit(None).cast("string")
    return log.select(F.col("event_id").alias("n"), "user_email", F.col("event_id").cast("string").alias("event_id"),
                      F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_time"), "status", "path", "intent", "model",
                      F.when(F.col("model") == B.PRIVATE, "1").alias("model_version"), "chunk_ids", null.alias("flags"), null.alias("question"), null.alias("answer"))


@query
def chain_build(spark, sf):
    return chain.chain(_chain_rows(spark, sf), ["n"], ["user_email"]).select("user_email", "event_id", "seq", "prev_hash", "row_hash")


@query
def chain_verify(spark, sf):
    """A chain per user with planted damage: rows edited, removed and re-hashed."""
    c = chain.chain(_chain_rows(spark, sf), ["n"], ["user_email"])
    bad = c.filter("n % 97 <> 5").withColumn("status", F.when(F.col("n") % 89 == 3, "edited").otherwise(F.col("status"))).withColumn(
        "row_hash", F.when(F.col("n") % 83 == 2, F.md5("row_hash")).otherwise(F.col("row_hash")))
    return chain.verify_chain(bad, ["user_email"], bucket_rows=16).select("user_email", "seq", "problem", "detail")


@query
def to_chat_log(spark, sf):
    r = B.chat_log(spark, sf).withColumn("sources", F.when(F.col("status") == "ok", F.split("chunk_ids", "-"))).drop("matched_chunks").withColumn(
        "error", F.when(F.col("status") != "ok", F.repeat(F.col("status"), 60))).withColumn("generate_s", F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("generate_s").cast("string")))
    c = audit.to_chat_log(r)
    return c.select(ts_text("event_time"), *[x for x in c.columns if x != "event_time"])


@query
def to_compliance(spark, sf):
    r = B.chat_log(spark, sf).withColumn("sources", F.when(F.col("status") == "ok", F.split("chunk_ids", "-"))).withColumn(
        "error", F.when(F.col("status") != "ok", F.repeat(F.col("status"), 30))).withColumn("flags", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("grounding_failed"))))
    return audit.to_compliance(r.withColumn("event_id", F.col("event_id").cast("string")), B.PRIVATE, "3")


@query
def vector_topk(spark, sf):
    e = B.table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.vector_topk(q, e).select("query_id", "vec_id", "rank")


@query
def vector_topk_scoped(spark, sf):
    e = B.table(spark, sf, "embeddings").withColumn("side", F.when(F.col("label") % 2 == 0, "phi").otherwise("general"))
    q = e.select(F.col("vec_id").alias("query_id"), "embedding", "side")
    return vector.vector_topk(q, e, scope="side").select("query_id", "vec_id", "rank")


@query
def lineage_asof(spark, sf):
    """Versions go live with every sign-up event, three endpoints; requests are all events."""
    e = B.table(spark, sf, "events")
    ep = F.concat(F.lit("endpoint-"), F.col("event_id") % 3)
    v = e.filter("event_type = 'signup'").select(ep.alias("endpoint"), F.col("event_id").alias("version"), F.col("ts").alias("valid_from"))
    r = e.select("event_id", ep.alias("endpoint"), F.col("ts").alias("event_time"))
    return lineage.lineage_asof(r, v).select("event_id", "endpoint", "version")


def _endpoint_changes(spark, sf):
    """A state per sign-up event, three endpoints; every fifth is retired six hours later, whether or not the next has come."""
    e = B.table(spark, sf, "events").filter("event_type = 'signup'")
    i = F.col("event_id")
    return e.select(F.concat(F.lit("endpoint-"), i % 3).alias("endpoint"), F.concat(F.lit("model-"), i % 4).alias("model"), i.alias("version"),
                    F.when(i % 3 == 2, F.lit("hosted")).alias("provider"), F.col("ts").cast("timestamp").alias("valid_from"),
                    F.when(i % 5 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 6 HOURS")).alias("valid_to"))


@query
def lineage_endpoints(spark, sf):
    """Every event as a request: the prompt, model, version and provider that answered it, or that its endpoint had none."""
    e = B.table(spark, sf, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    path = F.when(F.col("user_id") % 2 == 0, "phi").otherwise("general")
    prompts = e.filter("event_type = 'error'").select(path.alias("path"), F.col("event_id").alias("version"), F.col("event_time").alias("valid_from"))
    asked = e.select("event_id", path.alias("path"), F.concat(F.lit("endpoint-"), F.col("event_id") % 3).alias("endpoint"), "event_time")
    return lineage.request_lineage(asked, prompts, _endpoint_changes(spark, sf)).drop("event_time")


@query
def endpoint_history_problems(spark, sf):
    return lineage.history_problems(_endpoint_changes(spark, sf)).select("endpoint", "problem", ts_text("starts"), ts_text("ends"))


@query
def decision_rows(spark, sf):
    return lineage.decision_rows(route.route(B.questions(spark, sf), _registry(spark, sf)), "v2", B.PRIVATE, B.EXTERNAL)


@query
def vector_topk_indexed(spark, sf):
    """The exact mode of the index, with so few probes that most queries have to go on."""
    e = B.table(spark, sf, "embeddings")
    index = vector_index.build(e)
    found = vector_index.search(e.select(F.col("vec_id").alias("query_id"), "embedding"), index, probes=2, exact=True)
    return found.select("query_id", "vec_id", "rank", "certified")


@query
def vector_topk_indexed_scoped(spark, sf):
    e = B.table(spark, sf, "embeddings").withColumn("side", F.when(F.col("label") % 2 == 0, "phi").otherwise("general"))
    index = vector_index.build(e, scope="side")
    found = vector_index.search(e.select(F.col("vec_id").alias("query_id"), "embedding", "side"), index, probes=2, exact=True, scope="side")
    return found.select("query_id", "vec_id", "rank", "certified")


# ------------------------------------------------------------------ streams, run until nothing is left, and read back
def _medallion(spark, sf):
    """Two loads: every other encounter and all labs first, then all encounters and the beds, so that half of the encounters come twice."""
    root = scratch(spark)
    e, n = B.raw_encounters(spark, sf), F.regexp_extract("value", '"(?:id":"ENC-|reference":"Patient/)([0-9]+)', 1).cast("long")
    put = lambda df, feed: df.select("value").write.mode("append").option("compression", "gzip").text(f"{root}/in/{feed}")
    put(e.filter(n % 2 == 0), "ehr_fhir")
    put(B.raw_labs(spark, sf), "lab_results")
    put(B.raw_beds(spark, sf).filter(F.get_json_object("value", "$.beds_total") == 0), "scheduling")
    medallion.run_pipeline(spark, f"{root}/in", f"{root}/out", lines=True)
    put(e, "ehr_fhir")
    put(B.raw_beds(spark, sf), "scheduling")
    return medallion.run_pipeline(spark, f"{root}/in", f"{root}/out", lines=True)


@query
def medallion_counts(spark, sf):
    """What two loads of the three feeds kept and dropped, by rule, as counted while they were written."""
    return medallion.quality_counts(spark, _medallion(spark, sf))


@query
def medallion_gold(spark, sf):
    """The recomputed gold tables after both loads."""
    at = _medallion(spark, sf)
    g, b = spark.read.parquet(at["gold_patient_summary"]), spark.read.parquet(at["gold_bed_availability_by_unit"])
    rows = g.groupBy(F.col("unit").alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("encounter_id").alias("encounters"), F.count("test_code").alias("labs"))
    return rows.unionByName(b.groupBy(F.col("beds_total").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("long").alias("encounters"), F.lit(None).cast("long").alias("labs")))


#: requests from here on come in the second load, and with them stragglers that are more than a day older
SECOND_LOAD = "2024-01-16 00:00:00"


@query
def rate_limit_stream(spark, sf):
    """The admission of :func:`rate_limit` on a stream of two loads, the second with stragglers from behind the watermark."""
    root = scratch(spark)
    e = B.table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    old, gone = F.col("ts") < F.lit(SECOND_LOAD).cast("timestamp"), F.col("ts") < F.lit(SECOND_LOAD).cast("timestamp") - F.expr("INTERVAL 1 DAY")
    late = gone & (F.col("event_id") % 50 == 0)
    for part in (e.filter(old & ~late), e.filter(~old | late)):
        part.write.mode("append").parquet(f"{root}/in")
        out = limits.rate_limit_stream(spark.readStream.schema(e.schema).parquet(f"{root}/in"), "user_id", "ts", "event_id", limit=2, window_seconds=86400)
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "user_id", "admitted", "late")


# ------------------------------------------------------------------ end to end
def _sources(spark, sf):
    from wardline.plans.answer import Sources

    # tables in real use: written once, read by every step
    return Sources(stored(phi_chunks(spark, sf)), stored(general_chunks(spark, sf)), _registry(spark, sf), B.groups(spark, sf), B.staff(spark, sf), B.PRIVATE, B.EXTERNAL)


@query
def answer_batch(spark, sf):
    from wardline.plans.answer import answer_batch as answer

    a = answer(B.questions(spark, sf), _sources(spark, sf))
    return a.select("question_id", "status", "path", "intent", "model", "matched_chunks", joined("sources", "sources"), joined("flags", "flags"), "error",
                    F.when(F.col("model") == fixed.MODEL_COUNT, F.col("answer")).alias("count_answer"), F.col("prompt").isNotNull().alias("waits"))


@query
def finish_batch(spark, sf):
    """Replies of three kinds for all questions that wait for a model: no fact, an id, an unsupported number."""
    from wardline.plans import answer as A

    src = _sources(spark, sf)
    done = A.answer_batch(B.questions(spark, sf), src)
    k = F.col("question_id")
    replies = B.questions(spark, sf).select(k, F.when(k % 3 == 0, "Nothing in this can be counted.").when(k % 3 == 1, "It is 424242424.").otherwise("It is 77777.").alias("reply"))
    f = A.finish_batch(done, replies, src)
    return f.groupBy("status", "path", "model", joined("flags", "flags"), "error").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("matched_chunks").alias("matched"))
