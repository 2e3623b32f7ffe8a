"""URL filter by empirical-Bayes host reputation.

Rules judge the pages they fit; their outcomes (block = 1, allow = 0) are the labels. Block
counts are summed by host, registered domain and suffix, and every level is shrunk towards
the level above through a beta prior: the prior's mean is the parent's posterior mean, its
strength comes from the spread of the level's own rates (method of moments). A page without a
rule is blocked when the lower posterior bound of its host's block rate reaches ``TAU``;
hosts without labelled pages inherit domain, suffix or the global rate.

Only DataFrame functions; labelled counts are pre-aggregated by host before any join, so a
hot host costs one row.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and
is judged by the global rate; ports and user parts stay in the host; repeated rows are judged
each; an empty table gives an empty result; further columns are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Two-label suffixes end in one of these before a two-letter label (``co.uk``).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
Z = 1.6448536269514722       # one-sided 95 %
TAU = 0.5                    # block rate that a host's lower bound must reach
MIN_STRENGTH, MAX_STRENGTH, DEFAULT_STRENGTH = 1.0, 200.0, 10.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"),
         Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"),
         Rule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), AZ, az)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    last, before = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    two = before.isin(*SECOND_LEVEL) & (F.length(last) == 2)
    return F.when(two, F.concat_ws(".", before, last)).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one label before it; a bare suffix is its own domain."""
    labels = F.split(host, r"\.")
    n = F.size(F.split(suffix, r"\.")) + 1
    return F.when(F.size(labels) < n, host).otherwise(
        F.array_join(F.slice(labels, -n, n), "."))


def matched_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting rule's text, else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):        # later ones are longer and win
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.text)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules: tuple = RULES) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.text, F.lit(r.verdict)).otherwise(out)
    return out


def strength() -> Column:
    """Prior strength of one level from ``(n, k)`` per group by the method of moments:
    between-group variance of the rates against the binomial variance expected alone.
    Groups without spread give ``MAX_STRENGTH``, fewer than two ``DEFAULT``."""
    p = F.sum("k") / F.sum("n")
    s2 = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n"), 2)) / F.sum("n") - F.pow(p, 2)
    mean_var = p * (1 - p) * F.count("n") / F.sum("n")
    raw = (p * (1 - p) - s2) / F.nullif(s2 - mean_var, F.lit(0.0))
    return (F.when(F.count("n") < 2, F.lit(DEFAULT_STRENGTH))
            .when(raw.isNull() | (raw <= 0), F.lit(MAX_STRENGTH))
            .otherwise(F.least(F.greatest(raw, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))))


def host_reputation(hosts: DataFrame) -> DataFrame:
    """``(host, n, k)`` (labelled pages, blocked ones; n may be 0) to
    ``(host, rate, lower)``: posterior mean and lower bound of the block rate."""
    suffix = suffix_of(F.col("host"))
    base = hosts.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), suffix))
    domains = base.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    # a row per level, of a few numbers each
    levels = [df.select(F.lit(name).alias("level"), "n", "k") for name, df in
              (("suffix", suffixes), ("domain", domains), ("host", base))]
    every = levels[0].unionByName(levels[1]).unionByName(levels[2]).filter("n > 0").groupBy("level")
    found = {r["level"]: r for r in every.agg(strength().alias("m"), F.sum("n").alias("n"), F.sum("k").alias("k")).collect()}
    m = {name: found[name]["m"] if name in found else DEFAULT_STRENGTH for name in ("suffix", "domain", "host")}
    top = found.get("suffix")
    world = ((top["k"] if top else 0) + 0.5) / ((top["n"] if top else 0) + 1.0)

    def shrunk(prior: Column, weight: float) -> Column:
        return (F.col("k") + F.lit(weight) * prior) / (F.col("n") + F.lit(weight))

    s = suffixes.select("suffix", shrunk(F.lit(world), m["suffix"]).alias("sr"))
    d = domains.join(s, "suffix").select("domain", shrunk(F.col("sr"), m["domain"]).alias("dr"))
    h = base.join(d, "domain")
    a = F.col("k") + m["host"] * F.col("dr")
    b = F.col("n") - F.col("k") + m["host"] * (1 - F.col("dr"))
    rate = a / (a + b)
    sd = F.sqrt(rate * (1 - rate) / (a + b + 1))
    return h.select("host", rate.alias("rate"), (rate - Z * sd).alias("lower"))


def judge(pages: DataFrame, rules: tuple = RULES, tau: float = TAU) -> DataFrame:
    """``(page_id, host, path, rule, verdict, block_rate, block_lower)`` per page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    p = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    p = p.withColumn("__v", rule_verdict(F.col("rule"), rules))
    hosts = p.groupBy("host").agg(F.count("__v").alias("n"),
                                  F.count(F.when(F.col("__v") == "block", 1)).alias("k"))
    rep = host_reputation(hosts)
    method = F.when(F.col("lower") >= tau, F.lit("block")).otherwise(F.lit("allow"))
    return p.join(rep, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("__v", method).alias("verdict"),
        F.col("rate").alias("block_rate"), F.col("lower").alias("block_lower"))
