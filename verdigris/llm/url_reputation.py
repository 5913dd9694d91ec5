"""URL filtering by fixed rules and by an empirical-Bayes reputation of hosts.

Labelled outcomes of pages (bad or not) are counted by host.  A beta-binomial prior shrinks each
suffix to the whole, each registered domain to its suffix and each host to its domain; how strongly
is estimated at each level from how much the units of that level differ.  A page is blocked when the
lower bound of its host's posterior rate of bad pages is over a threshold, so hosts of which little
is known stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, remove, shared_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which names are registered, as in `co.uk`; fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
Z = 1.645
THRESHOLD = 0.5
LEAST_RHO, MOST_RHO, DEFAULT_RHO = 0.001, 0.2, 0.1


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty where there is no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def name_of(host: Column) -> Column:
    """The host without what stands before `@` and without a port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    """Of a host's name the last label, or the last two where the second is one of SECOND_LEVEL below a two-letter one."""
    pair = F.regexp_extract(host, r"(?:^|\.)((?:%s)\.[a-z]{2})$" % "|".join(SECOND_LEVEL), 1)
    return F.when(pair != "", pair).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and the label before it."""
    return F.when(suffix_of(host).contains("."), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of (rule host, rule path, verdict) that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for on, under, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        rule = F.when(fits, on + under).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def prior_strength(units: DataFrame) -> float:
    """Beta-binomial strength of one level by the moments of its units (columns n, bad)."""
    rate = F.col("bad") / F.col("n")
    # fixed number of sums
    s = units.filter("n > 0").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"), F.sum("bad").alias("bad"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * rate * rate).alias("r2"),
        F.sum(F.col("n") * rate * (1 - rate)).alias("within"),
    ).first()
    m, total = s["m"], s["all"] or 0
    if m < 2 or total <= m:
        rho = DEFAULT_RHO
    else:
        mean = s["bad"] / total
        between = (s["r2"] - total * mean * mean) / (m - 1)
        inside = s["within"] / (total - m)
        size = (total - s["n2"] / total) / (m - 1)
        below = between + (size - 1) * inside
        rho = (between - inside) / below if below > 0 else DEFAULT_RHO
    rho = min(MOST_RHO, max(LEAST_RHO, rho))
    return 1 / rho - 1


def host_reputation(labelled: DataFrame, z: float = Z) -> DataFrame:
    """host, n_pages, n, bad, mean, lower of every host, from rows (host, bad) where bad is 1, 0 or null (not labelled).

    Without a labelled row every mean is the prior of one half.  An empty table gives no rows.
    """
    hosts = labelled.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    name = name_of(F.col("host"))
    hosts = hosts.withColumn("domain", domain_of(name)).withColumn("suffix", suffix_of(name))
    spark, path = labelled.sparkSession, shared_dir(labelled.sparkSession)
    hosts = written(hosts, f"{path}/hosts")  # read by the jobs below
    domains = hosts.groupBy("domain", "suffix").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = written(domains, f"{path}/domains")
    suffixes = domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((whole["bad"] or 0) + 0.5) / ((whole["n"] or 0) + 1)
    k_suffix, k_domain, k_host = prior_strength(suffixes), prior_strength(domains), prior_strength(hosts)
    # a suffix like `com` has a large share of all domains, and a domain may have one of all hosts
    suffix_mean = suffixes.select("suffix", "units", ((F.col("bad") + overall * k_suffix) / (F.col("n") + k_suffix)).alias("suffix_mean"))
    domain_mean = join_groups(domains, written(suffix_mean, f"{path}/suffixes"), ["suffix"], "units", ["suffix_mean"])
    domain_mean = domain_mean.select("domain", "units", ((F.col("bad") + F.col("suffix_mean") * k_domain) / (F.col("n") + k_domain)).alias("domain_mean"))
    rated = join_groups(hosts, written(domain_mean, f"{path}/means"), ["domain"], "units", ["domain_mean"])
    a = F.col("bad") + F.col("domain_mean") * k_host
    b = F.col("n") - F.col("bad") + (1 - F.col("domain_mean")) * k_host
    mean, deviation = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    rated = written(rated.select("host", "n_pages", "n", "bad", mean.alias("mean"), (mean - z * deviation).alias("lower")), f"{path}/rated")
    for part in ("hosts", "domains", "suffixes", "means"):
        remove(spark, f"{path}/{part}")
    return rated


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str, str]],
    page: str = "page_id",
    url: str = "url",
    threshold: float = THRESHOLD,
    z: float = Z,
) -> DataFrame:
    """Judge every page: page, host, path, rule, verdict, bad_rate and bad_rate_lower (of its host).

    outcomes has one row (page, bad) per labelled page; several rows for a page count as the worst.
    Null urls and urls without `://` have an empty host and path and share one reputation.  Repeated
    rows of pages are judged one by one.  Without outcomes every reputation is the prior.
    """
    worst = outcomes.filter(F.col(page).isNotNull()).groupBy(page).agg(F.max("bad").alias("bad"))
    seen = pages.select(F.col(page), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rated = host_reputation(seen.join(worst, page, "left").select("host", "bad"), z)
    joined = join_groups(seen, rated, ["host"], "n_pages", ["mean", "lower"])
    rate, lower = F.col("mean"), F.col("lower")
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    method = F.when(lower > threshold, "block").otherwise("allow")
    return joined.select(page, "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), rate.alias("bad_rate"), lower.alias("bad_rate_lower"))
