"""Fill-in-the-middle by counted quantifiers.

A text is a row of units: blanks with the word behind them, and blanks at the end. ``regexp_count`` gives their number n, hashes of the id
choose two cuts a <= b among them and the form, and a pattern made for the row, ``(unit{a})(unit{b - a})(rest)``, captures prefix, middle
and suffix in one match, whose replacement is the output. The counted groups are possessive: no unit can match in two ways, so nothing is
ever given back, and the matcher runs them in a loop instead of a call per unit, at any length of text.

Forms: plain (the text as it is), psm (prefix, suffix, middle behind their marks) and spm (suffix, prefix, middle). Texts that hold a mark
stay plain, so an output can be read back from its marks alone; ``restore`` does so.

Defined results: a null text counts as empty, has no units and is plain; a null id counts as an empty string in the hash; repeated rows
come out alike. Other columns pass through, except those called like an output of ``transform``. Everything is row by row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"\x20\x09-\x0D"
UNIT = f"(?:[{BLANK}]*+[^{BLANK}]++|[{BLANK}]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: of 100: rows that are transformed, and of those the ones with the suffix first
RATE, SUFFIX_FIRST = 50, 80
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` without the text, with n, form, prefix_chars, middle_chars (code points; null if plain) and output."""
    rest = [c for c in docs.columns if c != text_col and c not in OUTPUTS]
    # the row is packed, so that its columns can have any names
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                    F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256).alias("hex"))
    h = lambda i: F.conv(F.substring("hex", 8 * i - 7, 8), 16, 10).cast("long")
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (h(3) % 100 >= rate)
    d = d.select("row", "text", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"), F.when(plain, "plain").when(h(4) % 100 < suffix_first, "spm").otherwise("psm").alias("form"), h(1).alias("h1"), h(2).alias("h2"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    d = d.withColumns({"a": F.least(a, b), "b": F.greatest(a, b)})
    pattern = F.format_string(rf"(?s)\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)(.*)\z", F.col("a"), F.col("b") - F.col("a"))
    made = F.when(F.col("form") == "spm", F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")).otherwise(F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"))
    d = d.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, made)))
    p, m, _ = parts(F.col("output"), F.col("form"))
    return d.select("row.*", "n", "form", F.length(p).cast("long").alias("prefix_chars"), F.length(m).cast("long").alias("middle_chars"), "output")


def parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """(prefix, middle, suffix) of an output; null if plain. The marks stand in no text, and none can arise where a text meets a mark."""
    first, second, third = (F.when(form == "spm", x).when(form == "psm", y) for x, y in ((SUFFIX, PREFIX), (PREFIX, SUFFIX), (MIDDLE, MIDDLE)))
    at2, at3 = F.locate(PREFIX, output), F.locate(MIDDLE, output)
    at2 = F.when(form == "spm", at2).otherwise(F.locate(SUFFIX, output))
    left = F.substring(output, F.length(first) + 1, at2 - 1 - F.length(first))
    right = F.substring(output, at2 + F.length(second), at3 - at2 - F.length(second))
    middle = F.substring(output, at3 + F.length(third), F.length(output))
    return F.when(form == "spm", right).when(form == "psm", left), F.when(form != "plain", middle), F.when(form == "spm", left).when(form == "psm", right)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    p, m, s = parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(p, m, s))


def digest(made: DataFrame) -> DataFrame:
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""
