"""URL filters: explicit host and path rules, else an empirical-Bayes host reputation.

The outcome of a labelled page is 1 where it was judged bad.  Bad rates are
shrunk level by level: the suffix (last label of the host) towards all pages,
the registered domain (last two labels, or three under one of ``SHARED``) towards its suffix, and the host
towards its domain.  At each level the prior is Beta(m * s, (1 - m) * s), with
m the posterior mean of the level above and s the strength, estimated for each
level by the method of moments from the spread of the groups' rates.  A host
is blocked if the lower posterior bound of its bad rate exceeds a threshold.

Only counts per host are shuffled: they are summed before any exchange, so a
host with a third of all pages is one row per task, and kept as one table that all levels come
from.  Suffixes with many domains, and hosts with many pages, are joined by broadcast (`join_counted`).

Defined results
---------------
* null url or one without ``://``: empty host and path, no rule, judged by the
  posterior of the empty host as any other host;
* hosts without labelled pages: judged by the prior, with the mean of the nearest
  level that has labels and the strength of hosts;
* null or missing outcomes: not counted; no outcomes at all: everything allowed;
* repeated pages count as often as they occur; extra columns are kept, but for those with the names
  of the results, which these replace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, lower_ascii, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Suffixes of two labels under which anyone may register; a parameter of the functions.
SHARED = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr")


def domain_of(host: Column, shared: tuple[str, ...] = SHARED) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*shared), F.substring_index(host, ".", -3)).otherwise(two) if shared else two


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (name, verdict), else null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame, mean: Column, low: float, high: float) -> DataFrame:
    """One row: the strength s of a level, from the variance of its groups' rates around the level above.

    With n pages and prior mean m, a group's rate has variance
    m (1 - m) (1 + (n - 1) / (s + 1)) / n; solved for s over the sums of all groups.
    """
    n, rate = F.col("n"), F.col("bad") / F.col("n")
    spread = F.sum(n * (rate - mean) * (rate - mean))
    base = F.sum(mean * (1 - mean))
    more = F.sum(mean * (1 - mean) * (n - 1))
    rho = F.try_divide(spread - base, more)  # 1 / (s + 1)
    return groups.agg(F.least(F.greatest(F.coalesce(F.try_divide(1 - rho, F.when(rho > 0, rho)), F.lit(high)), F.lit(low)), F.lit(high)).alias("s"))


def host_reputation(outcomes: DataFrame, others: DataFrame | None = None, z: float = 1.64, low: float = 1.0, high: float = 1000.0, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """Posterior per host from rows (host, bad 0/1): host, n, bad, posterior mean, lower and upper bound, pages (its rows in ``others``).

    ``others``: rows (host) that get one too, without labels from their levels' prior.
    """
    known = outcomes.where(F.col("bad").isNotNull() & F.col("host").isNotNull())
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    counted = known.select("host", one.alias("one"), F.col("bad").cast("long").alias("bad"), zero.alias("page"))
    if others is not None:
        counted = counted.unionByName(others.where(F.col("host").isNotNull()).select("host", zero.alias("one"), zero.alias("bad"), one.alias("page")))
    hosts = counted.groupBy("host").agg(F.sum("one").alias("n"), F.sum("bad").alias("bad"), F.sum("page").alias("pages"))
    hosts = written(hosts.withColumns({"domain": domain_of(F.col("host"), shared), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = written(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("rows")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("rows")), "suffixes")
    top = suffixes.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad")).where("all_n > 0").select(((F.col("all_bad") + 0.5) / (F.col("all_n") + 1)).alias("m"))

    def level(groups: DataFrame, above: DataFrame, on: str | None, name: str) -> DataFrame:
        """Adds the posterior's a and b; ``above`` has m, the mean of the level above, by ``on``, and how many groups it has."""
        joined = join_counted(groups, above, on, groups.count(), "__rows") if on else groups.join(F.broadcast(above))  # one row
        joined = written(joined, name)
        s = _strength(joined.where("n > 0"), F.col("m"), low, high)
        return joined.join(F.broadcast(s)).withColumns({"a": F.col("m") * F.col("s") + F.col("bad"), "b": (1 - F.col("m")) * F.col("s") + F.col("n") - F.col("bad")}).drop("m", "s")

    mean, rows = (F.col("a") / (F.col("a") + F.col("b"))).alias("m"), F.col("rows").alias("__rows")
    suffixes = level(suffixes, top, None, "suffix-level")
    domains = level(domains, suffixes.select("suffix", mean, rows), "suffix", "domain-level")
    hosts = level(hosts, domains.select("domain", mean, rows), "domain", "host-level")
    total = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    p = F.col("a") / total
    return hosts.select("host", "n", "bad", p.alias("posterior"), F.greatest(p - z * sd, F.lit(0.0)).alias("lower"), F.least(p + z * sd, F.lit(1.0)).alias("upper"), "pages")


RESULTS = ("host", "path", "rule", "verdict", "lower")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.25, z: float = 1.64, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """``pages`` with host, path, rule, verdict and lower (the bound that judged, null under a rule or without any outcomes).

    ``outcomes``: rows (url, bad).
    """
    url = F.col("url")
    rep = host_reputation(outcomes.select(host_of(url).alias("host"), "bad"), pages.select(host_of(url).alias("host")), z, shared=shared)
    kept = [c for c in pages.columns if c.lower() not in RESULTS]
    judged = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    judged = join_counted(judged, rep.select("host", "lower", F.col("pages").alias("__pages")), "host", pages.count(), "__pages", how="left")
    judged = judged.withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules))
    bad = F.coalesce(F.col("lower") > threshold, F.lit(False))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(bad, "block").otherwise("allow"))
    return judged.select(*kept, "host", "path", F.col("__rule.name").alias("rule"), verdict.alias("verdict"), F.when(F.col("__rule").isNull(), F.col("lower")).alias("lower"))
