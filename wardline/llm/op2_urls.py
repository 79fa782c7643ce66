"""URL filter: explicit rules first, then the reputation of the host by empirical Bayes.

Outcomes of labelled pages (bad or not) are counted by host. The rate of a suffix is shrunk towards that of the corpus, the rate of a
registered domain towards its suffix, and the rate of a host towards its domain. How strongly is fitted at each level: the method of
moments of the beta-binomial gives the overdispersion of the children around their parents' means, and with it the weight of the prior in
pages. A host is blocked if the lower bound of its posterior rate lies above ``factor`` times the rate of the corpus.

Defined results: a null url, or one without ``://``, has an empty host and path; it fits no rule and belongs to the host ``''``. Repeated
page ids are judged row by row and count as often as they stand; a labelled id with several labels is bad if one of them is. Without any
labels nothing is blocked by reputation. Hosts of one part, and addresses of numbers, are their own domain and suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, attach, keep

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: suffixes of two parts; all others have one
TWO_PART = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
Z, FACTOR = 1.645, 1.25
#: the fitted overdispersion stays between these, that is, a prior weighs 1 to 9,999 pages
RHO = (1e-4, 0.5)


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix)."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    parts = F.split(bare, "\\.")
    n, last2 = F.size(parts), F.substring_index(bare, ".", -2)
    whole = (n < 2) | bare.rlike("^[0-9.]+$")
    two = last2.isin(*TWO_PART)
    domain = F.when(whole, bare).when(two, F.substring_index(bare, ".", -3)).otherwise(last2)
    return domain, F.when(whole, bare).when(two, last2).otherwise(F.substring_index(bare, ".", -1))


def _rho(groups: DataFrame) -> float:
    """Overdispersion of the groups (n, bad) around the means in column m."""
    v = F.col("m") * (1 - F.col("m"))
    s, e, d = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)), F.sum(v), F.sum(v * (F.col("n") - 1))).first()
    return min(max((s - e) / d, RHO[0]), RHO[1]) if d else RHO[1]


def _shrunk(rho: float) -> Column:
    w = 1 / rho - 1
    return (F.col("bad") + w * F.col("m")) / (F.col("n") + w)


def reputation(pages: DataFrame, outcomes: DataFrame, factor: float = FACTOR, z: float = Z) -> DataFrame:
    """One row per host of ``pages`` (page_id, host): host, n_pages, n_labelled, rate, low, bad_host. ``outcomes`` has page_id, bad (0 or 1)."""
    once = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.join(once, "page_id").groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = domain_of(F.col("host"))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).join(seen, "host", "left").fillna(0, ["n", "bad"])
    hosts = keep(hosts.withColumns({"domain": domain, "suffix": suffix}))
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    mean = ((bad or 0) + 1) / ((n or 0) + 2)
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("m", F.lit(mean))
    suffixes = keep(level.withColumn("up", _shrunk(_rho(level))))
    level = keep(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes.select("suffix", F.col("up").alias("m")), "suffix"))
    level2 = level.withColumn("up", _shrunk(_rho(level))).select("domain", "suffix", F.col("up").alias("m"))
    level3 = keep(hosts.join(level2, ["suffix", "domain"]))
    rho = _rho(level3)
    w = 1 / rho - 1
    rate = _shrunk(rho)
    low = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + w + 1))
    return level3.withColumn("rate", rate).withColumn("low", low).select(
        "host", "n_pages", F.col("n").alias("n_labelled"), "rate", "low", (F.col("low") > factor * mean).alias("bad_host"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, factor: float = FACTOR, z: float = Z) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict."""
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rep = keep(reputation(p.select("page_id", "host"), outcomes, factor, z).select("host", "n_pages", "bad_host"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return attach(p, rep, "host", "n_pages", F.col("page_id")).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"))


def label_outcomes(labels: DataFrame) -> DataFrame:
    """A page is labelled by the row of ``labels`` with its id: bad if of low quality or toxic."""
    return labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").select(
        F.col("doc_id").alias("page_id"), F.expr("CAST(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS INT)").alias("bad"))


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
        FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
h0 AS (SELECT host, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY 1),
h1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM h0),
h AS (SELECT *, len(string_split(bare, '.')) < 2 OR regexp_matches(bare, '^[0-9.]+$') AS whole,
        regexp_extract(bare, '[^.]*[.][^.]*$') AS last2, regexp_extract(bare, '([^.]*[.])?[^.]*[.][^.]*$') AS last3, regexp_extract(bare, '[^.]*$') AS last1,
        regexp_extract(bare, '[^.]*[.][^.]*$') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz') AS two FROM h1),
hh AS (SELECT host, n, bad, CASE WHEN whole THEN bare WHEN two THEN last3 ELSE last2 END AS domain,
        CASE WHEN whole THEN bare WHEN two THEN last2 ELSE last1 END AS suffix FROM h),
g AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS mean FROM hh),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS m FROM hh, g GROUP BY 1),
rs AS (SELECT coalesce(greatest(least((sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.5), 1e-4), 0.5) AS rho FROM s WHERE n > 0),
su AS (SELECT suffix, (bad + (1 / rho - 1) * m) / (n + 1 / rho - 1) AS up FROM s, rs),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(up) AS m FROM hh JOIN su USING (suffix) GROUP BY 1, 2),
rd AS (SELECT coalesce(greatest(least((sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.5), 1e-4), 0.5) AS rho FROM d WHERE n > 0),
du AS (SELECT suffix, domain, (bad + (1 / rho - 1) * m) / (n + 1 / rho - 1) AS up FROM d, rd),
t AS (SELECT host, n, bad, up AS m FROM hh JOIN du USING (suffix, domain)),
rt AS (SELECT coalesce(greatest(least((sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.5), 1e-4), 0.5) AS rho FROM t WHERE n > 0),
r AS (SELECT host, (bad + (1 / rho - 1) * m) / (n + 1 / rho - 1) AS rate, n + 1 / rho AS total FROM t, rt),
v AS (SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / total) > 1.25 * mean AS bad_host FROM r, g)
SELECT page_id, host, path, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN bad_host THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN v USING (host)
"""
