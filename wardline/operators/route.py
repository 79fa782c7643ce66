"""Intent and fail-closed routing of a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import fixed
from wardline.functions import text as X
from wardline.operators.names import name_hits, raw_name_hits, with_name_hit
from wardline.operators.tags import Registry
from wardline.session import small_lookup, text_list


def classify_intent(questions: DataFrame, names: DataFrame | None = None, id_col: str = "question_id",
                    col: str = "question", rules=None) -> DataFrame:
    """Adds ``intent``: a known name or a 7 to 10 digit token means a clinical lookup, else the first keyword rule."""
    q = questions
    named = X.has_long_number_token(F.col(col))
    if names is not None:
        q = with_name_hit(q, raw_name_hits(q, names, id_col, col), id_col, "_named")
        named = named | F.col("_named")
    intent = F.when(named, F.lit(fixed.NAMED_INTENT)).otherwise(X.keyword_intent(F.col(col), rules))
    return q.withColumn("intent", intent).select(*questions.columns, "intent")


def intent_decisions(spark, phi: DataFrame, known: DataFrame, intent_tables: dict[str, list[str]] | None = None) -> DataFrame:
    """Per intent of the rule table: its tables, whether it is PHI and why. No mapped table, a table that does not
    exist, or a tagged one all mean PHI."""
    mapping = fixed.INTENT_TABLES if intent_tables is None else intent_tables
    rows = [(i, n, t) for i, ts in mapping.items() for n, t in enumerate(ts)]
    m = spark.createDataFrame(rows, "intent string, n int, table_name string")
    m = (m.join(known.select("table_name").distinct().withColumn("_known", F.lit(True)), "table_name", "left")
         .join(phi.select("table_name").distinct().withColumn("_phi", F.lit(True)), "table_name", "left"))
    by_n = lambda s: F.transform(F.array_sort(s), lambda x: x["table_name"])
    g = m.groupBy("intent").agg(
        F.collect_list(F.struct("n", "table_name")).alias("_all"),
        F.collect_list(F.when(F.col("_known").isNull(), F.struct("n", "table_name"))).alias("_missing"),
        F.bool_or(F.coalesce("_phi", F.lit(False))).alias("_tagged"))
    missing = by_n("_missing")
    reason = (F.when(F.size("_missing") > 0, F.format_string(fixed.REASON_MISSING, text_list(missing)))
              .when(F.col("_tagged"), fixed.REASON_PHI).otherwise(fixed.REASON_GENERAL))
    return g.select("intent", by_n("_all").alias("tables"), ((F.size("_missing") > 0) | F.col("_tagged")).alias("phi"),
                    reason.alias("reason"))


def route(questions: DataFrame, registry: Registry, intent_tables: dict[str, list[str]] | None = None,
          id_col: str = "question_id", col: str = "question") -> DataFrame:
    """Adds ``intent, tables, phi, reason``."""
    q = classify_intent(questions, registry.names, id_col, col)
    d = small_lookup(intent_decisions(questions.sparkSession, registry.phi, registry.known, intent_tables), 10_000)
    return q.join(d, "intent", "left").select(
        *questions.columns, "intent", F.coalesce("tables", F.array().cast("array<string>")).alias("tables"),
        F.coalesce("phi", F.lit(True)).alias("phi"), F.coalesce("reason", F.lit(fixed.REASON_UNKNOWN)).alias("reason"))


def with_identifiers(df: DataFrame, names: DataFrame | None, id_col: str, col: str, out: str, fuzzy: bool = True) -> DataFrame:
    """Adds the kinds of identifier in a text, known names (also misspelt) included."""
    if names is None:
        return df.withColumn(out, X.find_identifiers(F.col(col)))
    h = with_name_hit(df, name_hits(df.filter(F.col(col).isNotNull()), names, id_col, col, fuzzy), id_col, "_hit")
    return h.withColumn(out, X.find_identifiers(F.col(col), name_hit=F.col("_hit"))).drop("_hit")


def redirect_leaks(routed: DataFrame, names: DataFrame | None, id_col: str = "question_id", col: str = "question",
                   fuzzy: bool = True) -> DataFrame:
    """A general question that carries an identifier becomes a PHI question, with a flag. Adds ``flags``."""
    general = with_identifiers(routed.filter(~F.col("phi")), names, id_col, col, "_kinds", fuzzy)
    leak = F.size("_kinds") > 0
    none = F.array().cast("array<string>")
    fixed_up = general.withColumn("flags", F.when(leak, F.array(F.lit(fixed.FLAG_LEAK))).otherwise(none)).withColumn(
        "reason", F.when(leak, F.format_string(fixed.REASON_LEAK, text_list(F.col("_kinds")))).otherwise(F.col("reason"))
    ).withColumn("phi", leak).drop("_kinds")
    return routed.filter("phi").withColumn("flags", none).unionByName(fixed_up)


def screen(questions: DataFrame, col: str = "question") -> DataFrame:
    """Adds ``blocked_reason``: null for questions that may go on."""
    return questions.withColumn("blocked_reason", X.screen_reason(F.col(col)))
