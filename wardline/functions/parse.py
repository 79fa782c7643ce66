"""Parsing and rendering expressions: raw JSON documents, record text, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import fixed

# field -> JSON path of the three raw feeds
ENCOUNTER_PATHS = {
    "encounter_id": "$.id",
    "patient_ref": "$.subject.reference",
    "patient_name": "$.subject.display",
    "mrn": "$.identifier[0].value",
    "encounter_class": "$.class.display",
    "period_start": "$.period.start",
    "unit": "$.location[0].location.display",
    "diagnosis_code": "$.reasonCode[0].coding[0].code",
}
LAB_PATHS = {
    "mrn": "$.patient_mrn",
    "lab_encounter_id": "$.encounter_id",
    "test_code": "$.test_code",
    "result_value": "$.result_value",
    "result_flag": "$.result_flag",
    "observed_at": "$.observed_at",
}
BED_PATHS = {"unit": "$.unit", "beds_total": "$.beds_total", "beds_available": "$.beds_available", "as_of": "$.as_of"}
BED_CASTS = {"beds_total": "int", "beds_available": "int"}


def parse_json(df: DataFrame, paths: dict[str, str], casts: dict[str, str] | None = None, col: str = "value",
               ingested_at: bool = False) -> DataFrame:
    """One column per JSON path. A missing path or a malformed document gives nulls, and so does a value that does
    not fit its cast, never an error that would stop the load. ``get_json_object`` streams to its path and builds no
    tree, so eight short paths cost eight partial scans of one text and no shuffle."""
    casts = casts or {}
    cols = []
    for name, path in paths.items():
        c = F.get_json_object(col, path)
        cols.append((c.try_cast(casts[name]) if name in casts else c).alias(name))
    if ingested_at:
        cols.append(F.current_timestamp().alias("_ingested_at"))
    return df.select(*cols)


def with_ingested_at(df: DataFrame, name: str = "_ingested_at") -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def display_ts(col: Column, with_date: bool = True) -> Column:
    """``2026-09-10T08:00:00Z`` as ``10 Sep 2026, 08:00`` (or ``10 Sep 08:00``); anything else passes through."""
    ts = F.try_to_timestamp(F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.substring(col, 1, 19)),
                            F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.coalesce(F.date_format(ts, "d MMM yyyy, HH:mm" if with_date else "d MMM HH:mm"), col)


_LAB_TYPE = "array<struct<test:string,value:string,flag:string,time:string>>"


def parse_record_text(df: DataFrame, col: str = "content", prefix: str = "") -> DataFrame:
    """Adds ``parsed`` and the fields of an encounter text, with its labs as an array of structs. A lab list of
    which one item does not parse gives null ``labs`` beside its text. Text of another form keeps its row."""
    rx = "(?dU)" + fixed.RECORD_PATTERN
    names = ["patient_name", "mrn", "encounter_class", "encounter_id", "period_start", "unit", "diagnosis_code",
             "labs_text"]
    part = F.col("_parts")
    out = df.withColumn("_parts", _groups(F.col(col), rx, 8)).withColumn(prefix + "parsed", part.isNotNull())
    for i, n in enumerate(names):
        out = out.withColumn(prefix + n, F.nullif(part[i], F.lit("")) if n == "labs_text" else part[i])
    out = out.drop("_parts")
    items = F.filter(F.split(F.col(prefix + "labs_text"), "; "), lambda x: x != "")
    lab_rx = "(?dU)" + fixed.LAB_PATTERN
    out = out.withColumn("_items", F.transform(items, lambda x: _groups(x, lab_rx, 4)))
    fields = F.transform("_items", lambda x: F.struct(*[x[i].alias(n) for i, n in enumerate(["test", "value", "flag", "time"])]))
    whole = (F.size("_items") > 0) & F.forall("_items", lambda x: x.isNotNull())
    return out.withColumn(prefix + "labs", F.when(whole, fields).cast(_LAB_TYPE)).drop("_items")


def _groups(text: Column, rx: str, n: int) -> Column:
    """The ``n`` groups of a pattern from ``^`` to ``$``, or null without a match, by a single match: the groups are written out
    with a mark between them. Texts that hold the mark are matched once per group."""
    mark = "\x01"
    one = F.split(F.regexp_replace(text, rx, mark.join(f"${i}" for i in range(1, n + 1)) + mark), mark, -1)
    slow = F.array(*[F.regexp_extract(text, rx, i) for i in range(1, n + 1)])
    pick = lambda x: F.when(F.contains(text, F.lit(mark)), F.when(text.rlike(rx), slow)).when(F.size(x) == n + 1, F.slice(x, 1, n))
    return F.transform(F.array(one), pick)[0]


def format_record(df: DataFrame, col: str = "content", out: str = "markdown") -> DataFrame:
    """Adds one record as Markdown: a header, the visit, then a lab table. Text that does not parse becomes a
    plain bullet, so nothing is dropped."""
    keep = df.columns
    p = parse_record_text(df, col, prefix="_r_")
    c = {n: F.col("_r_" + n) for n in ["parsed", "patient_name", "mrn", "encounter_class", "encounter_id",
                                       "period_start", "unit", "diagnosis_code", "labs_text", "labs"]}
    labels = F.create_map(*[F.lit(x) for kv in fixed.FLAG_LABELS.items() for x in kv])

    def lab_line(x):
        test = F.concat(F.upper(F.substring(x["test"], 1, 1)), F.substring(x["test"], 2, 1 << 30))
        return F.concat(F.lit("| "), test, F.lit(" | "), x["value"], F.lit(" | "),
                        F.coalesce(F.element_at(labels, x["flag"]), x["flag"]), F.lit(" | "),
                        display_ts(x["time"], False), F.lit(" |"))

    table = F.concat(F.lit("\n\n| Lab | Result | Flag | Taken |\n|---|---|---|---|\n"),
                     F.array_join(F.transform(c["labs"], lab_line), "\n"))
    tail = (F.when(c["labs"].isNotNull(), table)
            .when(c["labs_text"].isNotNull(), F.concat(F.lit("\nLabs: "), c["labs_text"]))
            .otherwise(F.lit("")))
    head = F.concat(F.lit("**"), c["patient_name"], F.lit("** · MRN "), c["mrn"], F.lit("\n"), c["unit"], F.lit(" · "),
                    c["encounter_class"], F.lit(" · "), display_ts(c["period_start"]), F.lit(" · diagnosis "),
                    c["diagnosis_code"], F.lit(" · "), c["encounter_id"])
    md = F.when(c["parsed"], F.concat(head, tail)).otherwise(F.concat(F.lit("• "), F.col(col)))
    return p.select(*keep, md.alias(out))


def redact(col: Column, cap: int = fixed.SAFE_ERROR_CHARS) -> Column:
    """Error text that is safe to show or store: bearer tokens replaced, length capped."""
    return F.substring(F.regexp_replace(col, fixed.BEARER_PATTERN, fixed.BEARER_TEXT), 1, cap)


def refusal_fields(col: Column) -> Column:
    """A gateway refusal payload as struct(side, flagged, categories, message); all null for other texts."""
    text = F.regexp_replace(col, " ", "")
    side = (F.when(F.contains(text, F.lit('"input_guardrail"')), "question")
            .when(F.contains(text, F.lit('"output_guardrail"')), "answer"))
    is_refusal = side.isNotNull() & F.contains(text, F.lit('"flagged":true'))
    cats = F.array_sort(F.array_distinct(F.array_except(
        F.regexp_extract_all(text, F.lit('"([a-z0-9-]+)":true'), F.lit(1)), F.array(F.lit("flagged")))))
    shown = F.array_join(F.transform(cats, lambda x: F.regexp_replace(x, "-", " ")), ", ")
    msg = F.concat(F.lit("The AI Gateway's safety filter blocked this "), side,
                   F.when(F.size(cats) > 0, F.concat(F.lit(" ("), shown, F.lit(")"))).otherwise(F.lit("")),
                   F.lit(". Try rephrasing it."))
    return F.struct(F.when(is_refusal, side).alias("side"), F.coalesce(is_refusal, F.lit(False)).alias("flagged"),
                    F.when(is_refusal, cats).alias("categories"), F.when(is_refusal, msg).alias("message"))


def parse_refusals(df: DataFrame, col: str) -> DataFrame:
    r = refusal_fields(F.col(col))
    return df.select("*", r.alias("_refusal")).select(*df.columns, "_refusal.*")


def classify_outcome(df: DataFrame, err_type: str = "error_type", err_text: str = "error_text",
                     phi: str = "phi") -> DataFrame:
    """Adds ``status`` (ok, failed, blocked, denied) and ``message`` (safe to show) from the kind and text of what
    stopped a request; ``error_type`` null means nothing did."""
    t, x = F.col(err_type), F.col(err_text)
    scope = (t == "read") & F.contains(x, F.lit("Invalid scope"))
    perm = (t == "read") & F.col(phi) & F.upper(x).rlike("PERMISSION|INSUFFICIENT|NOT_FOUND|FORBIDDEN")
    refusal = refusal_fields(x)["message"]
    status = (F.when(t.isNull(), "ok").when((t == "guardrail") | refusal.isNotNull(), "blocked")
              .when((t == "permission") | scope | perm, "denied").otherwise("failed"))
    message = (F.when(t.isNull(), F.lit(None).cast("string")).when(t == "guardrail", x)
               .when(refusal.isNotNull(), refusal).when(scope, F.lit(fixed.DENIED_SCOPE))
               .when(perm, F.lit(fixed.DENIED_CLINICAL)).when(t == "permission", x)
               .otherwise(redact(F.concat_ws(": ", t, x))))
    return df.select("*", status.alias("status"), message.alias("message"))


DOCUMENT = T.StructType([T.StructField("value", T.StringType()), T.StructField("source_file", T.StringType())])
