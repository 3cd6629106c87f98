"""URL filters by empirical-Bayes host reputation, in DataFrame operations only.

Rules come first: a rule (host, path, allow or block) fits a url whose host is the rule's or a
subdomain of it and whose path starts with the rule's; the longest fitting rule decides. Urls that
no rule fits are judged by their host's labelled outcomes. Bad outcomes follow a beta-binomial at
every level, shrunk from above: all pages -> public suffix -> registered domain -> host. A level
passes its posterior mean down as the prior mean of its children, with a prior strength estimated
from how much the children's rates differ beyond binomial noise (method of moments over the
children of all parents). A host is blocked if the lower bound of its posterior bad rate, mean -
z x standard deviation, is above ``limit``.

The public suffix is the longest of ``suffixes`` that the host ends with, or else its last label; the
registered domain is one label more (ports, user names and a last dot don't count; an address is
a domain of its own). Hosts without labelled pages have their
domain's posterior, and so on up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut

from marlstone.llm.suffixes import SUFFIXES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z = 1.0
LIMIT = 0.3
STRENGTH = (1.0, 200.0)  # least and most pseudo-counts of a prior
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased. Null or no ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end. Null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """(public suffix, registered domain) of a host. A host that is a public suffix is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    part = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(part, F.greatest(F.size(part) - (n - 1), F.lit(1)), n), ".")
    suffix, domain = last(1), last(2)
    for n in sorted({s.count(".") + 1 for s in suffixes}):  # the longest is asked first
        fits = last(n).isin([s for s in suffixes if s.count(".") + 1 == n])
        suffix, domain = F.when(fits, last(n)).otherwise(suffix), F.when(fits, last(n + 1)).otherwise(domain)
    address = name.rlike(r"^([0-9]+\.){3}[0-9]+$") | name.startswith("[")
    return F.when(address, name).otherwise(suffix), F.when(address, name).otherwise(domain)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as a string, its verdict) of the longest fitting rule; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _level(children: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """Posterior (a, b) of children (key, parent, n, bad) under the posterior means of parents (parent, mean).

    Strength by moments: with r the children's rates around their parents' means m, the excess of
    sum n (r - m)^2 over its binomial expectation sum m (1 - m) estimates the intra-class
    correlation rho, and the strength is (1 - rho) / rho, held within STRENGTH.
    """
    both = children.join(parents.select(parent, F.col("mean").alias("prior")), parent)
    m, n, x = F.col("prior"), F.col("n"), F.col("bad")
    told = F.col("n") > 0
    spread = F.sum(F.when(told, (x - n * m) * (x - n * m) / n)).alias("s")
    noise = F.sum(F.when(told, m * (1 - m))).alias("e")
    extra = F.sum(F.when(told, (n - 1) * m * (1 - m))).alias("f")
    fit = both.agg(spread, noise, extra)
    rho = (F.col("s") - F.col("e")) / F.col("f")
    strength = F.when((F.col("f") > 0) & (rho > 0), F.least(F.greatest((1 - rho) / rho, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(F.lit(STRENGTH[1]))
    fit = fit.select(F.coalesce(strength, F.lit(STRENGTH[1])).alias("k"))
    a = F.col("prior") * F.col("k") + x
    b = (1 - F.col("prior")) * F.col("k") + n - x
    return both.crossJoin(F.broadcast(fit)).select(key, parent, a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))  # fit is one row


def reputation(pages: DataFrame, labels: DataFrame, key: str = "page_id", label_key: str = "doc_id", url: str = "url", bad: Column | None = None,
               suffixes=SUFFIXES, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """(host, domain, suffix, mean, bound, blocked), a row a host of pages.

    labels are page outcomes that meet pages by key, which is taken on trust; each label row is one
    outcome, a null outcome none. Counts are combined before they are shuffled, so a hot host costs no more.
    """
    bad = (F.col("toxic") > 0) | (F.col("quality") <= 0) if bad is None else bad
    host = host_of(F.col(url))
    seen = pages.select(F.col(key).alias("key"), host.alias("host"))
    marks = labels.select(F.col(label_key).alias("key"), bad.cast("long").alias("bad")).where("bad is not null and key is not null")
    told = seen.join(marks, "key").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = seen.select("host").distinct().join(told, "host", "left").na.fill(0, ["n", "bad"])
    suffix, domain = registered(F.col("host"), suffixes)
    # counts by host and by domain are read several times: written once, pages are scanned for them once
    hosts = cut(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("all", F.lit(1))
    # Jeffreys' half counts keep the overall rate off 0 and 1
    whole = suffixes.groupBy("all").agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("mean"))
    by_suffix = cut(_level(suffixes, "suffix", whole, "all"), "suffixes")
    by_domain = cut(_level(domains, "domain", by_suffix, "suffix"), "domains")
    by_host = _level(hosts.drop("suffix"), "host", by_domain, "domain")
    total = F.col("a") + F.col("b")
    bound = F.col("mean") - z * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return by_host.select("host", "domain", "mean", bound.alias("bound"), (bound > limit).alias("blocked"))


def judged(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, **how) -> DataFrame:
    """(key, host, path, rule, verdict), a row a row of pages; every url has a verdict.

    Urls without a host (null, or no ://) share one reputation, that of the empty host. Pages and
    hosts meet in one equality join, which Spark splits where a host is hot.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    known = reputation(pages, labels, key=key, url=url, **how).select("host", "blocked")
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path")).join(known, "host", "left")
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    own = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return rows.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
