"""URL filters: listed rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix. Each level is a beta-binomial:
its prior's mean is the posterior mean of the level above, its prior's strength is estimated by moments from how much
the level's rates differ beyond chance. So a host with few labelled pages is judged like its domain, a domain with few
like its suffix. A page is blocked when even the lower bound of its host's posterior is above the bad rate of all labelled pages
(or above a tolerated rate that the caller gives): when its host is worse than the average, beyond what chance explains.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by the overall
rate; pages without outcomes get the prior; ties cannot arise, as the longest fitting rule is one of a chain of nested
hosts and paths; repeated rows give repeated rows; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, kept

#: (verdict, rule): the rule's host up to its first slash, then the path's beginning.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels under which names are registered (fixed values).
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx")
Z = 1.645
LEAST_STRENGTH, MOST_STRENGTH = 0.5, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as its place in ``rules``; null if none does."""
    out = F.lit(None).cast("int")
    for i, (_, rule) in sorted(enumerate(rules), key=lambda x: len(x[1][1])):  # the last to fit is the longest
        of, slash, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    bare = F.regexp_replace(host, r":\d*$", "")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(*LONG_SUFFIXES)
    return F.when(long, F.substring_index(bare, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(bare, ".", -1))


def _strength(groups: DataFrame) -> Column:
    """Prior strength by moments: how far the groups' rates (k of n) differ beyond what chance gives. Null without groups."""
    n, g = F.sum("n"), F.count(F.lit(1))
    p = (F.sum("k") + 0.5) / (n + 1.0)
    chance = p * (1 - p)
    spread = F.sum(F.col("k") * F.col("k") / F.col("n")) - F.sum("k") * F.sum("k") / n
    room = n - F.sum(F.col("n") * F.col("n")) / n - (g - 1)
    rho = F.when(room > 0, (spread / chance - (g - 1)) / room)
    return F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), F.when(rho > 0, (1 - rho) / rho).otherwise(MOST_STRENGTH)))


def host_reputation(outcomes: DataFrame, z: float = Z) -> tuple[DataFrame, float]:
    """Per host: ``host, n, k, mean, low, overall`` from ``outcomes`` (``host, bad``); and the lower bound for hosts without outcomes.

    Counts are summed before anything is joined, so no host's pages meet in one task.
    """
    domain, suffix = domain_of(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.sum("bad").cast("double").alias("k")).filter("n > 0")
    hosts = kept(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # one row each reaches the driver: the overall rate and the three priors' strengths
    overall, s_suffix = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1.0)).alias("overall"), _strength(suffixes).alias("s")).first()
    s_domain, s_host = (f.agg(_strength(f).alias("s")).first()["s"] or LEAST_STRENGTH for f in (domains, hosts))
    mean = lambda above, s: (F.col("k") + s * above) / (F.col("n") + s)
    suffixes = suffixes.select("suffix", mean(F.lit(overall), s_suffix or LEAST_STRENGTH).alias("m_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", mean(F.col("m_suffix"), s_domain).alias("m_domain"))
    a, b = F.col("k") + s_host * F.col("m_domain"), F.col("n") - F.col("k") + s_host * (1 - F.col("m_domain"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    known = hosts.join(domains, ["domain", "suffix"]).select("host", "n", "k", (a / (a + b)).alias("mean"), F.greatest(F.lit(0.0), a / (a + b) - z * sd).alias("low"), F.lit(overall).alias("overall"))
    low = max(0.0, overall - z * (overall * (1 - overall) / (s_host + 1)) ** 0.5)
    return known, low


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_bad_rate: float | None = None) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict``. ``outcomes``: ``host, bad`` (0 or 1), a row a labelled page.

    ``max_bad_rate``: the bad rate tolerated; None: that of all outcomes, which a host without outcomes cannot exceed.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation, unknown = host_reputation(outcomes)
    known = kept(reputation.select(F.col("host").alias("its_host"), (F.col("low") > (F.col("overall") if max_bad_rate is None else max_bad_rate)).alias("bad")))
    by_host = F.when(F.coalesce("bad", F.lit(max_bad_rate is not None and unknown > max_bad_rate)), "block").otherwise("allow")
    at = rule_of(F.col("host"), F.col("path"), rules)
    named = parts.withColumn("at", at).join(known, F.col("host") == F.col("its_host"), "left")
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in rules]), F.col("at") + 1)
    return named.select(
        "page_id", "host", "path", F.when(F.col("at").isNotNull(), pick(1)).alias("rule"),
        F.when(F.col("at").isNotNull(), pick(0)).otherwise(by_host).alias("verdict"),
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, bad`` for the pages whose url ends in the number of a labelled document; bad: of low quality or toxic."""
    host, path = url_parts(F.col("url"))
    number = F.try_to_number(F.nullif(F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html)?/?$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    marked = labels.groupBy(F.col("doc_id").alias("number")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).filter("bad is not null")
    return pages.select(host.alias("host"), number.alias("number")).join(marked, "number").select("host", "bad")
