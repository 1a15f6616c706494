"""URL filter: explicit rules, and empirical-Bayes reputation of hosts for the rest.

A rule is a host and a path prefix; it fits that host and its subdomains, and the longest that
fits decides (of equally long ones that with the longer host, then allow). Pages that a rule
decides are the labelled outcomes. From them hosts get a reputation: the number of bad pages is
taken as beta-binomial, and the share of bad pages is shrunk from the whole corpus to the suffix,
from the suffix to the registered domain, from there to the host. How strongly each level holds to
the one above is estimated from the outcomes themselves (moments of the beta-binomial over the
groups of that level). A page without a rule is blocked if the lower bound of its host's posterior
share of bad pages is over a limit.

The suffix is the host's last label and the registered domain its last two, or one more of each where a host ends
in one of `suffixes`, a list of public suffixes of two labels such as co.uk (none is assumed). Counting combines before it shuffles: a host that has a third of all pages
sends one row from each task; pages then join the host table, which has one row a host.

Cases: a null url or one without :// has empty host and path, which are one host. Rules never fit
an empty host. Without any labelled outcome every other page is allowed. Repeated pages are judged
each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import saved

#: (verdict, host, path prefix). The list is a parameter and short; it becomes part of the plan.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Standard deviations below the posterior mean, share of bad pages, prior strength without evidence and its bounds.
Z, LIMIT, STRENGTH, LEAST, MOST = 1.0, 0.5, 10.0, 0.1, 1000.0

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The deciding rule as (rule, verdict), or null; the longest first, so the first that fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "allow")):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame, up: str, on: str | None) -> float:
    """The prior strength that the spread of groups (n, k) around their parents (column up, by on) shows."""
    v = F.col(up) * (1 - F.col(up))
    by = groups.where("n > 0").groupBy(*([on] if on else []), up).agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col(up), F.lit(2.0))).alias("s"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("n").alias("t"), F.count("*").alias("g")
    )
    above, below = by.agg(F.sum(F.col("s") - v * (F.col("g") - 1)), F.sum(v * (F.col("t") - F.col("nn") / F.col("t") - (F.col("g") - 1)))).first()
    if above is None or below <= 0:
        return STRENGTH
    rho = above / below
    return MOST if rho <= 0 else max(LEAST, min(MOST, (1 - rho) / rho))


def reputations(hosts: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """From (host, n labelled pages, k bad ones): host, bad_mean, bad_low. n may be 0.

    Only single numbers reach the driver: the corpus' share of bad pages and a strength for each level.
    """
    label = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(label, -n, n), ".")
    longer = (F.size(label) > 1) & last(2).isin(*suffixes) if suffixes else F.lit(False)
    suffix = F.when(longer, last(2)).otherwise(F.element_at(label, -1))
    domain = F.when(longer & (F.size(label) > 2), last(3)).when(F.size(label) > 1, last(2)).otherwise(F.col("host"))
    hosts = hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    hosts = saved(hosts)
    add = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = hosts.groupBy("domain", "suffix").agg(*add)
    tops = domains.groupBy("suffix").agg(*add)
    n, k = tops.agg(*add).first()

    def shrunk(df: DataFrame, on: str | None) -> DataFrame:
        m = F.lit(_strength(df, "up", on))
        return df.withColumn("a", F.col("k") + m * F.col("up")).withColumn("b", F.col("n") - F.col("k") + m * (1 - F.col("up")))

    mean = F.col("a") / (F.col("a") + F.col("b"))
    tops = shrunk(tops.withColumn("up", F.lit(k / n if n else 0.0)), None).select("suffix", mean.alias("up"))
    domains = shrunk(domains.join(tops, "suffix"), "suffix").select("domain", mean.alias("up"))
    total = F.col("a") + F.col("b")
    low = mean - F.lit(Z) * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return shrunk(hosts.join(domains, "domain"), "domain").select("host", mean.alias("bad_mean"), low.alias("bad_low"))


def judge(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", rules=RULES, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_low (the host's posterior bound)."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(page_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("by", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "by.rule", F.col("by.verdict").alias("ruled"))
    hosts = rows.groupBy("host").agg(F.count("ruled").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("k"))
    verdict = F.coalesce("ruled", F.when(F.col("bad_low") > LIMIT, F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(reputations(hosts, suffixes), "host").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_low")
