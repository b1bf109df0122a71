"""URL verdicts from rules and an empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted for each host, registered
domain and suffix.  Each level's rate is a beta-binomial posterior whose prior
comes from the level above: suffixes shrink to the overall rate, domains to
their suffix, hosts to their domain.  What a prior is worth is estimated for
each level from the outcomes themselves, by moments: counts of n outcomes
around a mean m have a variance of n m (1 - m) (1 + (n - 1) / (worth + 1)).
A page is blocked if the lower quantile of its host's posterior rate is under
a threshold.

The suffix is the host's last label, or one of a list of longer suffixes that
the host ends in; the registered domain has one label more.  A port counts for
neither.  Null urls and urls without ``://`` have an empty host and path, which
is a host like any other.  Null outcomes are no outcomes; a table without any
gives every level the mean 0.5.  Repeated rows count as often as they occur; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written

#: Least and most outcomes that a prior is worth; the normal deviate of the posterior's quantile (2.5 %); least quantile let through.
WORTH, DEVIATE, LEAST = (1.0, 10000.0), 1.96, 0.6
#: Suffixes of two labels; a public list can be passed instead.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fits(host: Column, path: Column, rule: str) -> Column:
    """Whether a rule like ``example.net/en/`` fits: its host or a subdomain, and a path that starts with its path."""
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def with_rule(pages: DataFrame, rules: dict[str, str], host: str = "host", path: str = "path") -> DataFrame:
    """Columns ``rule`` and ``ruled``: the longest rule that fits and its verdict, or nulls.  rules: verdict by rule."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        fits = rule_fits(F.col(host), F.col(path), r)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(rules[r])).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


def _levels(hosts: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    longer = "".join(rf"(?<![^.]){re.escape(s)}$|" for s in sorted(suffixes, key=lambda s: (-len(s), s)))
    hosts = hosts.withColumn("name", F.regexp_replace("host", r":[0-9]*$", ""))
    hosts = hosts.withColumn("suffix", F.regexp_extract("name", longer + r"[^.]*$", 0))
    rest = F.substring("name", F.lit(1), F.length("name") - F.length("suffix"))
    return hosts.withColumn("domain", F.concat(F.regexp_extract(rest, r"([^.]*\.)?$", 0), F.col("suffix"))).drop("name")


def _worth(level: DataFrame) -> float:
    """Outcomes that the prior ``above`` is worth at a level with counts n and good."""
    m, n = F.col("above"), F.col("n")
    chance = n * m * (1 - m)
    excess = F.sum((F.col("good") - n * m) * (F.col("good") - n * m) - chance) / F.nullif(F.sum((n - 1) * chance), F.lit(0.0))
    share = F.least(F.greatest(F.coalesce(excess, F.lit(0.0)), F.lit(1 / (WORTH[1] + 1))), F.lit(1 / (WORTH[0] + 1)))
    return level.agg(1 / share - 1).first()[0]


def lower_quantile(a: Column, b: Column, deviate: float) -> Column:
    """A low quantile of a beta distribution by Carter's approximation; parameters under 1 count as 1."""
    p, q = 1 / (2 * F.greatest(a, F.lit(1.0)) - 1), 1 / (2 * F.greatest(b, F.lit(1.0)) - 1)
    h, c = 2 / (p + q), (deviate * deviate - 3) / 6
    w = deviate * F.sqrt(h + c) / h - (q - p) * (c + 5 / 6 - 2 / (3 * h))
    return F.greatest(a, F.lit(1.0)) / (F.greatest(a, F.lit(1.0)) + F.greatest(b, F.lit(1.0)) * F.exp(2 * w))


def host_reputation(outcomes: DataFrame, deviate: float = DEVIATE, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Columns host and outcome to one row for each host: host, n, mean and lower, the quantile of its posterior.

    The hosts' counts are written once, as each level's estimate reads them;
    four numbers come to the driver.  The rates of the levels above are joined
    by their names; Spark broadcasts a level only where it finds it small.
    """
    hosts = outcomes.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("double").alias("good"))
    hosts = written(_levels(hosts, suffixes), "hosts")
    counts = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    good, n = hosts.agg(F.sum("good"), F.sum("n")).first()

    def shrunk(level: DataFrame) -> DataFrame:
        worth = F.lit(_worth(level))
        return level.withColumns({"mean": (F.col("good") + worth * F.col("above")) / (F.col("n") + worth), "whole": F.col("n") + worth})

    tops = shrunk(hosts.groupBy("suffix").agg(*counts).withColumn("above", F.lit(good / n if n else 0.5)))
    domains = hosts.groupBy("suffix", "domain").agg(*counts).join(tops.select("suffix", F.col("mean").alias("above")), "suffix")
    found = shrunk(hosts.join(shrunk(domains).select("domain", F.col("mean").alias("above")), "domain"))
    return found.select("host", "n", "mean", lower_quantile(F.col("mean") * F.col("whole"), (1 - F.col("mean")) * F.col("whole"), deviate).alias("lower"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], deviate: float = DEVIATE, least: float = LEAST, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, lower (the posterior's quantile).

    ``outcomes`` has page_id and outcome; several outcomes of a page all count.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = parsed.select("page_id", "host").join(outcomes.filter(F.col("outcome").isNotNull()), "page_id", "left").select("host", "outcome")
    lower = host_reputation(known, deviate, suffixes).select("host", "lower")
    judged = with_rule(parsed, rules).join(lower, "host")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.round("lower", 9) >= least, "allow").otherwise("block")).alias("verdict"), F.round("lower", 6).alias("lower"))


#: Fixed rules of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

ORACLE = """
WITH parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
counted AS (
  SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, count(quality) AS n, coalesce(sum(quality), 0)::DOUBLE AS good
  FROM parsed LEFT JOIN labels ON page_id = doc_id GROUP BY host),
ends AS (
  SELECT *, CASE WHEN regexp_matches(name, '(^|\\.)(ac\\.uk|co\\.jp|co\\.nz|co\\.uk|com\\.au|com\\.br|gov\\.uk|org\\.uk)$')
    THEN regexp_extract(name, '[^.]*\\.[^.]*$', 0) ELSE regexp_extract(name, '[^.]*$', 0) END AS suffix
  FROM counted),
hosts AS (SELECT *, regexp_extract(name[:length(name) - length(suffix)], '([^.]*\\.)?$', 0) || suffix AS domain FROM ends),
suffixes AS (
  SELECT suffix, sum(n)::DOUBLE AS n, sum(good) AS good, (SELECT coalesce(sum(good) / nullif(sum(n), 0), 0.5) FROM hosts) AS m
  FROM hosts GROUP BY suffix),
suffix_worth AS (
  SELECT 1 / least(greatest(coalesce(sum((good - n * m) * (good - n * m) - n * m * (1 - m)) / nullif(sum((n - 1) * n * m * (1 - m)), 0), 0), 1 / 10001.0::DOUBLE), 0.5::DOUBLE) - 1 AS w
  FROM suffixes),
domains AS (
  SELECT h.domain, sum(h.n)::DOUBLE AS n, sum(h.good) AS good, any_value((s.good + w * m) / (s.n + w)) AS m
  FROM hosts h JOIN suffixes s USING (suffix), suffix_worth GROUP BY h.domain),
domain_worth AS (
  SELECT 1 / least(greatest(coalesce(sum((good - n * m) * (good - n * m) - n * m * (1 - m)) / nullif(sum((n - 1) * n * m * (1 - m)), 0), 0), 1 / 10001.0::DOUBLE), 0.5::DOUBLE) - 1 AS w
  FROM domains),
priors AS (
  SELECT h.host, h.n::DOUBLE AS n, h.good, (d.good + w * m) / (d.n + w) AS m
  FROM hosts h JOIN domains d USING (domain), domain_worth),
host_worth AS (
  SELECT 1 / least(greatest(coalesce(sum((good - n * m) * (good - n * m) - n * m * (1 - m)) / nullif(sum((n - 1) * n * m * (1 - m)), 0), 0), 1 / 10001.0::DOUBLE), 0.5::DOUBLE) - 1 AS w
  FROM priors),
posteriors AS (SELECT host, greatest(good + w * m, 1) AS a, greatest(n - good + w * (1 - m), 1) AS b FROM priors, host_worth),
terms AS (
  SELECT host, a, b, 1 / (2 * a - 1) AS p, 1 / (2 * b - 1) AS q, 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1)) AS h,
    (1.96::DOUBLE * 1.96::DOUBLE - 3) / 6 AS c
  FROM posteriors),
lowers AS (
  SELECT host, a / (a + b * exp(2 * (1.96::DOUBLE * sqrt(h + c) / h - (q - p) * (c + 5 / 6.0::DOUBLE - 2 / (3 * h))))) AS lower
  FROM terms),
ruled AS (
  SELECT page_id, p.host, path, lower,
    CASE
      WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (p.host = 'org' OR p.host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (p.host = 'net' OR p.host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
    END AS rule
  FROM parsed p JOIN lowers USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN round(lower, 9) >= 0.6 THEN 'allow' ELSE 'block' END AS verdict,
  round(lower, 6) AS lower
FROM ruled
"""
