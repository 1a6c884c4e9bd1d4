"""URL filters with empirical-Bayes host reputation (operator 1), native.

Rules (host and path prefix, allow or block) come first: a rule fits its host
and all subdomains if the path starts with the rule's; the longest wins. Other
urls get the verdict of their host's reputation: labelled page outcomes are
binomial counts, shrunk from suffix to registered domain to host. At each level
the prior is a beta distribution whose mean is the parent's posterior mean,
from the labels of the parent's other children only, so that no label counts
twice, and whose strength is estimated from all groups of the level by moments
(overdispersion of the beta-binomial). A host is allowed if the lower bound of
its posterior, mean - z * deviation (a normal approximation, rough for one or
two labels), reaches ``least``; a host without labels has its domain's prior,
an unknown domain that of its suffix.

Labels are summed by host before anything is joined, so a hot host moves as
one row for each task, and the pages meet the hosts' small rows last.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged as the host "" without a domain; null labels and
labels of no page are left out; several labels of a page count each; rows that
repeat a page are judged alike; without any label the prior mean is 0.5; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stash

#: Suffixes of two labels, under which domains are registered; fixed values, a parameter.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "org.au", "org.uk")
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LEAST, Z = 0.6, 1.6448536269514722
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str = "url"):
    """Columns host and path of a url."""
    host = F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def domain_of(host, two_label=TWO_LABEL_SUFFIXES):
    """Columns suffix and registered domain of a host; a host without a dot is both."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.least(n, F.lit(k))), ".")
    two = last(2).isin(*two_label)
    return F.when(two, last(2)).otherwise(last(1)), F.when(two, last(3)).otherwise(last(2))


def rule_for(rules=RULES):
    """Columns verdict and rule of the longest rule that fits host and path, null if none does."""
    verdict, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        verdict, rule = F.when(fits, kind).otherwise(verdict), F.when(fits, text).otherwise(rule)
    return verdict, rule


def strength(groups: DataFrame) -> float:
    """The prior's strength from rows (good, n) of a level's groups, by moments; one number comes to the driver."""
    sums = groups.agg(
        F.sum("good").alias("g"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("s2"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("good") * F.col("good") / F.col("n")).alias("q"),
    )
    mean = F.col("g") / F.col("s")
    var = mean * (1 - mean)
    # sum n (p - mean)^2 = sum good^2 / n - g^2 / s
    between = F.col("q") - F.col("g") * F.col("g") / F.col("s") - var * (F.col("k") - 1)
    room = var * (F.col("s") - F.col("s2") / F.col("s") - (F.col("k") - 1))
    rho = F.least(F.greatest(F.coalesce(F.try_divide(between, room), F.lit(0.0)), F.lit(0.005)), F.lit(0.5))
    return sums.select(1 / rho - 1).first()[0]


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, mean, lower) for every host of ``pages`` (host); outcomes: (host, good, n), sums of labels."""
    counts = outcomes.groupBy("host").agg(F.sum("good").cast("double").alias("good"), F.sum("n").cast("double").alias("n"))
    hosts = stash(pages.select("host").distinct().join(counts, "host", "left").na.fill(0.0, ["good", "n"]), "hosts")
    suffix, domain = domain_of(F.col("host"))
    hosts = hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("good").alias("d_good"), F.sum("n").alias("d_n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("d_good").alias("s_good"), F.sum("d_n").alias("s_n"))
    good, n = suffixes.agg(F.coalesce(F.sum("s_good"), F.lit(0.0)), F.coalesce(F.sum("s_n"), F.lit(0.0))).first()
    level = lambda df, g, n: strength(df.select(F.col(g).alias("good"), F.col(n).alias("n")).filter("n > 0"))
    h = hosts.join(domains, ["suffix", "domain"]).join(suffixes, "suffix")
    m_s, m_d, m_h = map(F.lit, (level(suffixes, "s_good", "s_n"), level(domains, "d_good", "d_n"), level(hosts, "good", "n")))
    # each mean is made without the child that it is the prior of
    h = h.withColumn("t_mean", F.when(F.col("s_n") < n, (good - F.col("s_good")) / (n - F.col("s_n"))).otherwise(0.5))
    h = h.withColumn("s_mean", (m_s * F.col("t_mean") + F.col("s_good") - F.col("d_good")) / (m_s + F.col("s_n") - F.col("d_n")))
    h = h.withColumn("d_mean", (m_d * F.col("s_mean") + F.col("d_good") - F.col("good")) / (m_d + F.col("d_n") - F.col("n")))
    size = m_h + F.col("n")
    h = h.withColumn("mean", (m_h * F.col("d_mean") + F.col("good")) / size)
    return h.select("host", "domain", "suffix", "n", "mean", (F.col("mean") - F.lit(Z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))).alias("lower"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, least: float = LEAST, url: str = "url", key: str = "page_id", label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(key, host, path, rule, verdict, n_labels, mean, lower) of each page."""
    host, path = parts(url)
    pages = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    marks = labels.select(F.col(label_key).alias("page_id"), F.col(label).cast("int").alias("y")).filter("y is not null")
    marks = marks.groupBy("page_id").agg(F.sum("y").alias("good"), F.count("y").alias("n"))
    # only labelled pages are made distinct; a page that is there twice counts once
    outcomes = pages.select("page_id", "host").join(marks, "page_id").distinct()
    known = reputation(pages, outcomes).select(F.col("host").alias("h"), F.col("n").cast("long").alias("n_labels"), "mean", "lower")
    verdict, rule = rule_for(rules)
    out = pages.join(known, F.col("host") == F.col("h"))
    own = F.when(F.col("lower") >= least, "allow").otherwise("block")
    return out.select(F.col("page_id").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_labels", F.round("mean", 6).alias("mean"), F.round("lower", 6).alias("lower"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the verdict on every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judge(pages, labels)


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN {{{k}}}" for k, (h, p) in enumerate((t.partition("/")[0], t.partition("/")[2]) for _, t in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))))
_SORTED = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))


def _strength(table: str, good: str, n: str) -> str:
    return f"""SELECT 1 / least(greatest(coalesce(CASE WHEN room <> 0 THEN between_ / room END, 0.0), 0.005), 0.5) - 1 AS m FROM (
      SELECT q - g * g / s - v * (k - 1) AS between_, v * (s - s2 / s - (k - 1)) AS room FROM (
        SELECT *, (g / s) * (1 - g / s) AS v FROM (
          SELECT sum({good}) AS g, sum({n}) AS s, sum({n} * {n}) AS s2, count(*) AS k, sum({good} * {good} / {n}) AS q FROM {table} WHERE {n} > 0)))"""


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
counts AS (
  SELECT host, sum(quality)::DOUBLE AS good, count(quality)::DOUBLE AS n
  FROM (SELECT DISTINCT page_id, host FROM p) JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY host),
split_ AS (
  SELECT host, coalesce(good, 0) AS good, coalesce(n, 0) AS n, string_split(host, '.') AS l
  FROM (SELECT DISTINCT host FROM p) LEFT JOIN counts USING (host)),
hosts AS (
  SELECT host, good, n,
    CASE WHEN array_to_string(l[-2:], '.') IN ({_TWO}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
    CASE WHEN array_to_string(l[-2:], '.') IN ({_TWO}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain
  FROM split_),
domains AS (SELECT suffix, domain, sum(good) AS d_good, sum(n) AS d_n FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(d_good) AS s_good, sum(d_n) AS s_n FROM domains GROUP BY suffix),
total AS (SELECT sum(s_good) AS t_good, sum(s_n) AS t_n FROM suffixes),
ms AS ({_strength("suffixes", "s_good", "s_n")}),
md AS ({_strength("domains", "d_good", "d_n")}),
mh AS ({_strength("hosts", "good", "n")}),
a AS (
  SELECT h.*, d_good, d_n, md.m AS m_d, mh.m AS m_h, (ms.m * CASE WHEN s_n < t_n THEN (t_good - s_good) / (t_n - s_n) ELSE 0.5 END + s_good - d_good) / (ms.m + s_n - d_n) AS s_mean
  FROM hosts h JOIN domains USING (suffix, domain) JOIN suffixes USING (suffix), total, ms, md, mh),
b AS (SELECT *, (m_d * s_mean + d_good - good) / (m_d + d_n - n) AS d_mean FROM a),
c AS (SELECT host, n, m_h + n AS size, (m_h * d_mean + good) / (m_h + n) AS mean FROM b),
d AS (SELECT host, n, mean, mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)) AS lower_ FROM c)
SELECT page_id, host, path, CASE {_FITS.format(*(f"'{t}'" for _, t in _SORTED))} END AS rule,
  coalesce(CASE {_FITS.format(*(f"'{k}'" for k, _ in _SORTED))} END, CASE WHEN lower_ >= {LEAST} THEN 'allow' ELSE 'block' END) AS verdict,
  n::BIGINT AS n_labels, round(mean, 6) AS mean, round(lower_, 6) AS lower
FROM p JOIN d USING (host)
"""
