"""Column expressions over text: identifiers, input screen, tokens, grounding. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import fixed

# Unicode classes (U), Unicode case folding (u) and "only \n ends a line" (d): the dialect the rules are written in.
_DIALECT = "(?dU)"
_DIALECT_I = "(?iudU)"


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def find_identifiers(col: Column, patterns=None, name_hit: Column | None = None) -> Column:
    """Kinds of identifier found in a text, in fixed order; an empty array means none. ``name_hit`` is the boolean
    produced by :func:`wardline.operators.names.name_hits`, reported first."""
    kinds = [] if name_hit is None else [F.when(name_hit, F.lit(fixed.NAME_KIND))]
    kinds += [F.when(col.rlike(_DIALECT + rx), F.lit(kind)) for kind, rx in (patterns or fixed.IDENTIFIER_PATTERNS)]
    return F.array_compact(F.array(*kinds))


def fired_patterns(col: Column, patterns=None) -> Column:
    """Positions (from 1) of the injection patterns that match."""
    rules = patterns or fixed.INJECTION_PATTERNS
    return F.array_compact(F.array(*[F.when(col.rlike(_DIALECT_I + p), F.lit(i)) for i, p in enumerate(rules, 1)]))


def screen_reason(col: Column, max_chars: int = fixed.MAX_QUESTION_CHARS, patterns=None) -> Column:
    """Why a question is stopped before anything else happens, or null. One alternation, one pass over the text."""
    rules = patterns or fixed.INJECTION_PATTERNS
    joined = _DIALECT_I + "|".join(f"(?:{p})" for p in rules)
    return (F.when(F.length(col) > max_chars, F.lit(fixed.TOO_LONG_MSG))
            .when(col.rlike(joined), F.lit(fixed.INJECTION_MSG)))


def words(col: Column) -> Column:
    """Lower-case runs of letters and apostrophes, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z']+"), F.lit(0))


def tokens(col: Column) -> Column:
    """Distinct lower-case alphanumeric tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0)))


def query_tokens(col: Column, stopwords=None, synonyms=None) -> Column:
    """Tokens of a question without stopwords, synonyms applied, distinct."""
    stop, syn = stopwords or fixed.STOPWORDS, synonyms or fixed.SYNONYMS
    table = F.create_map(*[F.lit(x) for kv in syn.items() for x in kv])
    kept = F.array_except(tokens(col), _arr(stop))
    return F.array_distinct(F.transform(kept, lambda t: F.coalesce(F.element_at(table, t), t)))


def match_key(token: Column, prefix: int = fixed.PREFIX_LETTERS) -> Column:
    """The one equality key of the token rule: short tokens match exactly, longer ones on their first letters. A key of
    ``prefix`` letters always stands for a long token and a shorter one for a short token, so the two never meet."""
    return F.substring(token, 1, prefix)


def content_keys(col: Column, prefix: int = fixed.PREFIX_LETTERS) -> Column:
    """Distinct keys of all tokens of a text, cut out by the pattern itself in one pass."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(f"([a-z0-9]{{1,{prefix}}})[a-z0-9]*"), F.lit(1)))


def is_count_question(col: Column) -> Column:
    return col.rlike(_DIALECT_I + fixed.COUNT_PATTERN)


def has_long_number_token(col: Column) -> Column:
    """A whitespace-separated token of 7 to 10 digits."""
    return col.rlike(_DIALECT + r"(?:^|\s)\d{7,10}(?:\s|$)")


def keyword_intent(col: Column, rules=None, unknown: str = fixed.UNKNOWN_INTENT) -> Column:
    """First intent in rule order with a keyword in the text."""
    low = F.lower(col)
    out = None
    for intent, kws in (rules or fixed.INTENT_KEYWORDS):
        alts = "|".join(_quote(k.strip()) + (r"\b" if k.endswith(" ") else "") for k in kws)
        hit = low.rlike(_DIALECT + rf"\b(?:{alts})")
        out = F.when(hit, F.lit(intent)) if out is None else out.when(hit, F.lit(intent))
    return F.lit(unknown) if out is None else out.otherwise(F.lit(unknown))


def _quote(word: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in word)


def normalise_fact(col: Column) -> Column:
    """Edge punctuation off, lower case, leading zeros of digit runs off (06:30 equals 6:30)."""
    return F.regexp_replace(F.lower(F.btrim(col, F.lit(fixed.EDGE_PUNCTUATION))), _DIALECT + r"0(?<!\d0)0*(?=\d)", "")


def facts(col: Column) -> Column:
    """Every run of text that contains a digit: numbers, ids, codes, times, dates."""
    return F.regexp_extract_all(col, F.lit(_DIALECT + fixed.FACT_PATTERN), F.lit(0))


def unsupported_facts(answer: Column, records: Column) -> Column:
    """Facts of ``answer`` found neither as a token nor as a substring of ``records`` (one joined text), sorted. The records are normalised
    once for all facts of an answer. A token of them begins and ends where no digit does, so its normal form is a substring of
    theirs; only a sigma in it may be written otherwise (at the end of a word), so only facts with one are looked for among tokens."""
    def missing(support):
        def test(x):
            token = x["n"].rlike("[\u03c3\u03c2]") & F.array_contains(F.transform(facts(records), normalise_fact), x["n"])
            return (x["n"] != "") & ~F.contains(support, x["n"]) & ~token

        asked = F.transform(facts(answer), lambda t: F.struct(t.alias("t"), normalise_fact(t).alias("n")))
        return F.transform(F.filter(asked, test), lambda x: x["t"])

    # a lambda's variable is worked out once, an expression in its body for each element
    found = F.transform(F.array(normalise_fact(records)), missing)[0]
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.btrim(t, F.lit(fixed.LISTED_PUNCTUATION)))))
