"""URL filtering by rules and by empirical-Bayes host reputation, with DataFrame functions only.

Labelled page outcomes (good or bad) are summed per host. Rates are shrunk through beta-binomial priors: the global rate
is the prior of each suffix, the suffix posterior that of each registered domain, the domain posterior that of each host.
The prior strength of a level comes from the spread of its groups (method of moments for the intra-group correlation).
A host is blocked when the lower posterior bound of its bad rate exceeds ``max_bad``; hosts without labels take the
posterior of their domain, suffix or the global one. ``max_bad`` is a half: a host goes if, with 95% probability, most of
its pages are bad. It does not follow the global rate, since a corpus that is good or bad as a whole has no hosts that
stand out; where outcomes do not depend on hosts, as in the synthetic tables, no host is blocked, and that is right.

Assumption: the outcome of a page is the label row with the page's number.

Defined results: null urls and urls without ``://`` have empty host and path and take the global posterior; repeated
pages and repeated labels each count; pages without a label count nothing; empty tables give empty results; no labels at
all leave every page to the uniform prior, which allows; further columns do not matter. The registered domain is one label
more than the public suffix of the host; the suffix level is what follows its first label. Public suffixes come from a table
of rules, if one is given (``suffix_rules``): the longest fitting rule counts, an exception before all others, one label
where none fits, and a host that is itself a suffix is its own domain. Without a table a suffix is one label, or two where
these are in ``LONG_SUFFIXES``; that covers the synthetic pages, and real crawls need the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import materialize, small, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which anyone registers names, where no table of them is given.
LONG_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Bounds of the intra-group correlation (prior strength 1 / rho - 1 between about 0.1 and 999).
MIN_RHO, MAX_RHO = 0.001, 0.9


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def registered_domain(host: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    n = F.when(F.substring_index(host, ".", -2).isin(*long_suffixes), 3).otherwise(2) if long_suffixes else F.lit(2)
    return F.when(n == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.substring(domain, F.instr(domain, ".") + 1, F.length(domain))).otherwise(domain)


def suffix_rules(lines: DataFrame) -> DataFrame:
    """(key, more, exception) from lines (``suffix``) as public suffix lists have them.

    ``*.ck`` takes one label more than its key, the exception ``!www.ck`` one less. Comments (``//``), blank lines and nulls
    are left out; A-Z are lower-cased; repeated lines are one rule.
    """
    rule = F.translate(F.regexp_extract("suffix", r"^\s*(\S*)", 1), UPPER, LOWER)
    rules = lines.select(rule.alias("rule")).where("rule != '' and not startswith(rule, '//')").distinct()
    kind = F.when(F.col("rule").startswith("*."), 1).when(F.col("rule").startswith("!"), -1).otherwise(0)
    key = F.when(kind == 1, F.expr("substr(rule, 3)")).when(kind == -1, F.expr("substr(rule, 2)")).otherwise(F.col("rule"))
    return rules.select(key.alias("key"), kind.alias("more"), (kind == -1).alias("exception"))


def with_domains(hosts: DataFrame, lines: DataFrame) -> DataFrame:
    """``hosts`` (one row a host) and domain, by the public suffix rules in ``lines``.

    Only endings of a host as long as the longest key are looked up, so a host of very many labels costs no more than others.
    """
    rules = materialize(suffix_rules(lines), "suffixes")
    longest = rules.agg(F.max(F.size(F.split("key", "[.]")))).first()[0] or 1
    labels = F.size(F.split("host", "[.]"))
    endings = hosts.select("*", labels.alias("labels"), F.explode(F.sequence(F.lit(1), F.least(labels, F.lit(longest)))).alias("i"))
    endings = endings.withColumn("key", F.expr("substring_index(host, '.', -i)"))
    # a wildcard needs the label that it takes
    fits = F.col("more").isNotNull() & (F.col("i") + F.col("more") <= F.col("labels"))
    best = F.max(F.when(fits, F.struct("exception", (F.col("i") + F.col("more")).alias("n"))))
    found = endings.join(small(rules), "key", "left").groupBy(*hosts.columns).agg(F.coalesce(best["n"], F.lit(1)).alias("n_suffix"))
    return found.select(*hosts.columns, F.expr("substring_index(host, '.', -(n_suffix + 1))").alias("domain"))


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, or nulls. The rule list is part of the plan: keep it below a few thousand."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, tail = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{tail}")
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _rho(groups: DataFrame, n: str, bad: str, rate: str) -> DataFrame:
    """One row: the intra-group correlation of outcomes around the parent's rate, within bounds."""
    g = groups.where((F.col(n) >= 2) & (F.col(rate) > 0) & (F.col(rate) < 1))
    v = F.col(rate) * (1 - F.col(rate))
    over = F.sum((F.col(bad) - F.col(n) * F.col(rate)) * (F.col(bad) - F.col(n) * F.col(rate)) - F.col(n) * v)
    pairs = F.sum(F.col(n) * (F.col(n) - 1) * v)
    return g.agg(F.greatest(F.lit(MIN_RHO), F.least(F.lit(MAX_RHO), F.coalesce(F.try_divide(over, pairs), F.lit(MAX_RHO)))).alias("rho"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Posterior bad rate of every host in ``pages`` (page_id, host), and the global one (one row).

    ``outcomes``: (page_id, bad 0/1). ``suffixes``: lines of a public suffix list (suffix). Hosts: host, domain, suffix, n, bad, rate, strength, bound (lower).
    Counts are summed with map-side combining before any shuffle of hosts, so a hot host costs one row per task, and
    written: the levels above, and the result, start from these counts and never from pages again.
    """
    labelled = pages.join(outcomes.where(F.col("bad").isNotNull()), "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    placed = hosts.withColumn("domain", registered_domain(F.col("host"))) if suffixes is None else with_domains(hosts, suffixes)
    hosts = materialize(placed, "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db")).withColumn("suffix", suffix_of(F.col("domain")))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    top = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("gn"), F.coalesce(F.sum("sb"), F.lit(0)).alias("gb"))
    g = top.first()
    # uniform prior at the top
    base, strength = (g.gb + 1.0) / (g.gn + 2.0), g.gn + 2.0

    def level(groups: DataFrame, n: str, bad: str, parent: str, out: str) -> DataFrame:
        rho = _rho(groups, n, bad, parent).first().rho
        k = 1.0 / rho - 1.0
        return groups.withColumn(out, (F.col(bad) + k * F.col(parent)) / (F.col(n) + k)).withColumn(f"{out}_k", F.col(n) + F.lit(k))

    s = level(suffixes.withColumn("g", F.lit(base)), "sn", "sb", "g", "s_rate")
    d = level(domains.join(s.select("suffix", "s_rate"), "suffix"), "dn", "db", "s_rate", "d_rate")
    h = level(hosts.join(d.select("domain", "suffix", "d_rate"), "domain"), "n", "bad", "d_rate", "rate")
    h = h.withColumnRenamed("rate_k", "strength").withColumn("bound", lower_bound(F.col("rate"), F.col("strength"), z))
    return h, pages.sparkSession.createDataFrame([(base, strength)], "rate double, strength double")


def lower_bound(rate: Column, strength: Column, z: float) -> Column:
    """Lower posterior bound of a beta distribution with this mean and strength, by its normal approximation."""
    return rate - z * F.sqrt(rate * (1 - rate) / (strength + 1))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = 0.5, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_bound of every page with a ``url``."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation, _ = host_reputation(parsed.select("page_id", "host"), outcomes, z, suffixes)
    rule, action = match_rules(F.col("host"), F.col("path"), rules)
    known = materialize(reputation.select("host", F.col("rate").alias("bad_rate"), F.col("bound").alias("bad_bound")), "reputation")
    judged = parsed.join(small(known), "host", "left")
    method = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "bad_rate", "bad_bound")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages. Outcome of a page: the label row with its id, bad if of low quality or toxic."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0).alias("bad"))
    judged = filter_urls(table(spark, sf_dir, "pages"), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))


_SQL = """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
u AS (SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
o AS (SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END AS bad FROM labels),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM u LEFT JOIN (SELECT * FROM o WHERE bad IS NOT NULL) USING (page_id) GROUP BY host),
h1 AS (SELECT *, string_split(host, '.') AS l FROM h0),
h2 AS (SELECT host, n, bad, array_to_string(list_slice(l, greatest(1, len(l) - CASE WHEN array_to_string(list_slice(l, greatest(1, len(l) - 1), len(l)), '.') IN ('co.uk', 'org.uk', 'com.au', 'co.jp', 'com.br') THEN 2 ELSE 1 END), len(l)), '.') AS domain FROM h1),
d0 AS (SELECT domain, CASE WHEN instr(domain, '.') > 0 THEN substr(domain, instr(domain, '.') + 1) ELSE domain END AS suffix, sum(n) AS dn, sum(bad) AS db FROM h2 GROUP BY domain),
s0 AS (SELECT suffix, sum(dn) AS sn, sum(db) AS sb, (sum(sum(db)) OVER () + 1.0) / (sum(sum(dn)) OVER () + 2.0) AS g FROM d0 GROUP BY suffix),
sr AS (SELECT greatest(0.001, least(0.9, coalesce(sum((sb - sn * g) * (sb - sn * g) - sn * g * (1 - g)) / nullif(sum(sn * (sn - 1) * g * (1 - g)), 0), 0.9))) AS rho FROM s0 WHERE sn >= 2),
s1 AS (SELECT s0.*, (sb + (1 / rho - 1) * g) / (sn + (1 / rho - 1)) AS s_rate FROM s0, sr),
d1 AS (SELECT d0.*, s_rate FROM d0 JOIN s1 USING (suffix)),
dr AS (SELECT greatest(0.001, least(0.9, coalesce(sum((db - dn * s_rate) * (db - dn * s_rate) - dn * s_rate * (1 - s_rate)) / nullif(sum(dn * (dn - 1) * s_rate * (1 - s_rate)), 0), 0.9))) AS rho FROM d1 WHERE dn >= 2 AND s_rate > 0 AND s_rate < 1),
d2 AS (SELECT d1.*, (db + (1 / rho - 1) * s_rate) / (dn + (1 / rho - 1)) AS d_rate FROM d1, dr),
h3 AS (SELECT h2.*, d_rate FROM h2 JOIN d2 USING (domain)),
hr AS (SELECT greatest(0.001, least(0.9, coalesce(sum((bad - n * d_rate) * (bad - n * d_rate) - n * d_rate * (1 - d_rate)) / nullif(sum(n * (n - 1) * d_rate * (1 - d_rate)), 0), 0.9))) AS rho FROM h3 WHERE n >= 2 AND d_rate > 0 AND d_rate < 1),
h4 AS (SELECT host, (bad + (1 / rho - 1) * d_rate) / (n + (1 / rho - 1)) AS rate, n + (1 / rho - 1) AS k FROM h3, hr),
r(action, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM u JOIN r
      ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (k + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(rate, 6) AS bad_rate, round(rate - 1.645 * sqrt(rate * (1 - rate) / (k + 1)), 6) AS bad_bound
FROM u JOIN h4 USING (host) LEFT JOIN m USING (page_id)
"""

QUERIES = {"op8_url_filters": op8_url_filters}
SQL = {"op8_url_filters": _SQL}
