"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are summed by host before anything is joined, so a hot host costs one
partial sum in each task. A beta-binomial prior passes down from suffix to registered domain
to host; its strength on each level is estimated by moments from the groups of that level.
A host is blocked if the lower posterior bound of its rate of bad pages is over a limit: the rate of
all labelled pages, unless one is given, so hosts that are credibly worse than the average page go.
Hosts without labels take their domain's posterior. Every page has its host's posterior beside the verdict.

The registered domain is one label more than the public suffix. That is the longest entry of
``suffixes`` (a parameter; PUBLIC_SUFFIXES has only the most common ones of two labels) or else the
last label. A host's port counts as part of the host for rules, and not for reputation; a host of
digits and dots is a domain and suffix of its own.

Hot suffixes, domains and hosts are joined by broadcast (``spread_join``), so their rows stay dealt.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule
and has no reputation (nulls, allow); of rules of equal length the last in order of host, then path, then
verdict decides; without outcomes nothing is blocked by reputation; outcomes of unknown pages count nowhere; if a page has several
outcomes, each counts; repeated pages are judged separately; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import ascii_lower, pick, spread_join, staged

#: Rules of the registered query as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_RULES = 1000
#: Public suffixes of two labels, fixed values; more are given as a parameter.
PUBLIC_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr",
    "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "co.za", "com.ar",
)
#: The lower bound of a host's posterior is mean - Z * deviation.
Z = 1.645
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path of the url."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, form, i), F.lit(""))
    return pages.withColumns({"host": ascii_lower(part(1)), "path": part(2)})


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits, else nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: the list is part of the plan")
    name = verdict = F.lit(None).cast("string")
    for does, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(does)).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, level: str) -> DataFrame:
    """One row: the rate of all outcomes and the prior strength between the groups of a level."""
    g = groups.groupBy(level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where("n > 0")
    s = g.agg(F.sum("n").alias("t"), F.sum("bad").alias("b"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("sq"))
    m = F.col("b") / F.col("t")
    noise = m * (1 - m)
    between = (F.col("sq") - F.col("b") * m - (F.col("k") - 1) * noise) / F.nullif(noise * (F.col("t") - F.col("n2") / F.col("t") - (F.col("k") - 1)), F.lit(0.0))
    strength = F.when(between > 0, F.least(F.greatest(1 / between - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))).otherwise(F.lit(MOST_STRENGTH))
    return s.select(F.coalesce(m, F.lit(0.0)).alias("m"), strength.alias("k"))


def suffix_of(host: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> Column:
    """The public suffix of a host without its port; the host itself if it is an address."""
    last = lambda n: F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - n + 1, F.lit(1)), n), ".")
    found = last(1)
    for n in sorted({x.count(".") + 1 for x in suffixes}):
        found = F.when(last(n).isin(*[x for x in suffixes if x.count(".") + 1 == n]), last(n)).otherwise(found)
    return F.when(host.rlike(r"^[0-9.]*$"), host).otherwise(found)


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: one label more than the suffix, if the host has one."""
    rest = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    label = F.element_at(F.split(rest, r"\."), -1)
    return F.when(F.length(host) <= F.length(suffix) + 1, host).otherwise(F.concat_ws(".", label, suffix))


def host_reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> DataFrame:
    """From (host, n, bad), one row a host, its posterior: rate, deviation and lower bound; and the rate of all outcomes.

    Every level is a sum of the level below; the three prior strengths are single rows.
    """
    t = outcomes.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    t = staged(t.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "hosts")
    prior = {level: _strength(t, level).first() for level in ("suffix", "domain", "host")}
    blend = lambda n, bad, mean, k: (F.col(bad) + F.lit(k) * mean) / (F.col(n) + F.lit(k))
    rows, total = F.count(F.lit(1)).alias("rows"), t.count()
    domains = staged(t.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"), rows), "domains")
    levels = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"), F.count(F.lit(1)).alias("domains"))
    mean = blend("sn", "sb", F.lit(prior["suffix"].m or 0.0), prior["suffix"].k or MOST_STRENGTH).alias("smean")
    levels = staged(levels.select("suffix", mean, "domains"), "suffixes")
    domains = spread_join(domains, levels, "suffix", "domains", total=total)
    mean = blend("dn", "db", F.col("smean"), prior["domain"].k or MOST_STRENGTH).alias("dmean")
    domains = staged(domains.select("domain", mean, "rows"), "domain-rates")
    k = F.lit(prior["host"].k or MOST_STRENGTH)
    t = spread_join(t, domains, "domain", "rows", total=total).withColumn("rate", (F.col("bad") + k * F.col("dmean")) / (F.col("n") + k))
    t = t.withColumn("deviation", F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + k + 1)))
    bound = (F.col("rate") - F.lit(Z) * F.col("deviation")).alias("lower_bound")
    return t.select("host", "n", "bad", "rate", "deviation", bound, F.lit(prior["suffix"].m or 0.0).alias("overall"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float | None = None, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule and verdict of each page, with n, bad, rate and lower_bound of its host.

    ``outcomes`` has page_id and bad (0 or 1). They are joined to the pages' ids and hosts by
    page_id, which repeats no key often.
    """
    p = with_parts(pick(pages, page_id="page_id", url="url")).drop("url")
    p = staged(p.withColumn("_site", F.nullif(F.regexp_replace("host", ":[0-9]*$", ""), F.lit(""))), "parts")
    seen = pick(outcomes, page_id="page_id", bad="bad").where("page_id is not null and bad is not null")
    counted = p.where("_site is not null").join(seen, "page_id", "left").groupBy(F.col("_site").alias("host"))
    counted = staged(counted.agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("_n")), "outcomes")
    rated = host_reputation(counted.select("host", "n", "bad"), suffixes)
    over = F.col("lower_bound") > (F.col("overall") if limit is None else F.lit(limit))
    rated = rated.select("host", "n", "bad", F.round("rate", 6).alias("rate"), F.round("lower_bound", 6).alias("lower_bound"), F.when(over, "block").alias("by_host"))
    rated = rated.join(counted.select("host", "_n"), "host").withColumnRenamed("host", "_site")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    t = spread_join(p, staged(rated, "rated"), "_site", "_n", "left")
    t = t.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.col("by_host"), F.lit("allow"))})
    return t.select("page_id", "host", "path", "rule", "verdict", "n", "bad", "rate", "lower_bound")
