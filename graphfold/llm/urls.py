"""URL filters by empirical-Bayes reputation: hosts shrink towards their domain, domains towards their suffix.

Each level's labelled outcomes are beta-binomial. A level's prior mean is the posterior mean of the
level above, its strength is fitted to how far the level's outcomes scatter about these means; the
verdict follows the host's posterior distribution. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfold.plans.lineage import cut as written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Reputation:
    """A host is blocked if its rate of bad pages lies above limit with at least this certainty.

    long_suffixes stands for a full list of public suffixes, which is no part of this package and can be
    given in its place; all other suffixes are a host's last label.
    """

    limit: float = 0.5
    certainty: float = 0.95
    #: A strength is as many labelled pages as the level above counts; it is fitted within these borders,
    #: and is unfitted where no group has two labelled pages.
    least_strength: float = 0.1
    most_strength: float = 10_000.0
    unfitted: float = 1.0
    #: Places at which the posterior is summed on each side of the limit, up to wide standard deviations.
    places: int = 64
    wide: float = 8.0
    #: Suffixes of two labels under which domains are registered.
    long_suffixes: tuple[str, ...] = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
    hot_rows: int = 100_000  # a host with more pages is joined apart
    hot_hosts: int = 1000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to / ? # or the end, in lower case; then up to ? or #. Else both are empty."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substr(url, place + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower(host), path


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, a struct of rule and verdict, or null. Equal lengths: the one that sorts first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), [-ord(c) for c in r.host + r.path])):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def domain_of(host: Column, rule: Reputation) -> Column:
    """The registered domain: the public suffix and one label more, or the host if it has no more."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.isin(*rule.long_suffixes), three).otherwise(two)


def suffix_of(domain: Column) -> Column:
    """What follows a domain's first label; the domain itself if it has one label."""
    place = F.instr(domain, ".")
    return F.when(place > 0, F.substr(domain, place + 1, F.length(domain))).otherwise(domain)


def fitted(groups: DataFrame, n: str, b: str, mean: str, rule: Reputation) -> DataFrame:
    """One row, the strength s of beta priors with the given means, by the method of moments.

    b of n outcomes scatter by n m (1 - m) (1 + (n - 1) r) with r = 1 / (s + 1); the sums over all groups
    of what is on both sides give r.
    """
    spread = F.col(mean) * (1 - F.col(mean))
    sums = groups.agg(F.sum((F.col(b) - F.col(n) * F.col(mean)) * (F.col(b) - F.col(n) * F.col(mean)) - F.col(n) * spread).alias("over"), F.sum(F.col(n) * (F.col(n) - 1) * spread).alias("most"))
    r = F.col("over") / F.col("most")
    strength = F.when(F.coalesce(F.col("most"), F.lit(0.0)) <= 0, rule.unfitted).when(r <= 0, rule.most_strength).otherwise(F.least(F.greatest(1 / r - 1, F.lit(rule.least_strength)), F.lit(rule.most_strength)))
    return sums.select(strength.alias("s"))


def shrunk(groups: DataFrame, n: str, b: str, mean: str, rule: Reputation, name: str) -> DataFrame:
    """groups with the posterior mean under name, and the fitted strength under s_name."""
    strength = F.broadcast(fitted(groups, n, b, mean, rule).withColumnRenamed("s", f"s_{name}"))  # one row
    return groups.crossJoin(strength).withColumn(name, (F.col(b) + F.col(f"s_{name}") * F.col(mean)) / (F.col(n) + F.col(f"s_{name}")))


def chance_above(a: Column, b: Column, rule: Reputation) -> Column:
    """The chance that a beta variable lies above the limit.

    In log odds t its density is exp(a t) / (1 + exp(t))^(a + b), a bell; it is summed at the middles of
    equal steps on each side of the limit.
    """
    spread = F.sqrt(1 / a + 1 / b)
    centre = F.log(a / b)
    cut = (F.lit(log(rule.limit / (1 - rule.limit))) - centre) / spread
    cut = F.least(F.greatest(cut, F.lit(-rule.wide)), F.lit(rule.wide))
    peak = a * centre - (a + b) * F.log1p(F.exp(centre))

    def total(begin: Column, end: Column) -> Column:
        def at(i: Column) -> Column:
            t = centre + spread * (begin + (end - begin) * (i + 0.5) / rule.places)
            return F.exp(a * t - (a + b) * F.log1p(F.exp(t)) - peak)

        return (end - begin) * F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(rule.places - 1)), at), F.lit(0.0), lambda x, y: x + y)

    below, above = total(F.lit(-rule.wide), cut), total(cut, F.lit(rule.wide))
    return above / (below + above)


def reputations(outcomes: DataFrame, rule: Reputation) -> DataFrame:
    """(host, domain, suffix, pages, n_labelled, n_bad, rate, certainty) of each host of (host, labelled, bad).

    Levels are summed from the hosts' sums, so that the pages are counted once, partially before they
    are shuffled. With no labelled page at all, the prior is one half. certainty is the posterior chance
    that the host's rate lies above the limit.
    """
    hosts = written(outcomes.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"), F.count("*").alias("pages")).withColumn("domain", domain_of(F.col("host"), rule)).withColumn("suffix", suffix_of(F.col("domain"))), "hosts")
    whole = hosts.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("m_all"))  # one row
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n_d"), F.sum("b").alias("b_d"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n_d").alias("n_s"), F.sum("b_d").alias("b_s")).crossJoin(F.broadcast(whole))
    suffixes = shrunk(suffixes, "n_s", "b_s", "m_all", rule, "m_s").select("suffix", "m_s")
    domains = written(shrunk(domains.join(suffixes, "suffix"), "n_d", "b_d", "m_s", rule, "m_d").select("domain", "m_d"), "domains")
    judged = shrunk(hosts.join(domains, "domain"), "n", "b", "m_d", rule, "rate")
    certainty = chance_above(F.col("b") + F.col("s_rate") * F.col("m_d"), F.col("n") - F.col("b") + F.col("s_rate") * (1 - F.col("m_d")), rule)
    return judged.select("host", "domain", "suffix", "pages", F.col("n").alias("n_labelled"), F.col("b").alias("n_bad"), "rate", certainty.alias("certainty"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...], reputation: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:  # noqa: B008
    """(page_id, host, path, rule, verdict, rate, certainty) of every page.

    outcomes: (page_id, bad) of labelled pages, bad null or 0 or 1; a page's bad label counts if any of
    its rows says so. A rule's verdict stands; else a host is blocked if its certainty suffices. A
    null url, and one without ://, has an empty host, which is judged like any other. Rows that repeat
    come out as often as they came in.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    labels = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("bad")).where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = rows.select("page_id", "host").join(labels, "page_id", "left")
    known = reputations(labelled.select("host", F.col("bad").isNotNull().cast("long").alias("labelled"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad")), reputation)
    known = written(known, "reputations")
    # Hosts with very many pages are few: no more than hot_hosts of them, and joined without a shuffle of their pages.
    hot = known.where(F.col("pages") > reputation.hot_rows).orderBy(F.desc("pages"), "host").limit(reputation.hot_hosts).select("host", "rate", "certainty")
    hot = written(hot, "hot")
    apart = rows.join(F.broadcast(hot.select(F.col("host").alias("hot_host"))), F.col("host") == F.col("hot_host"), "left")
    few = apart.where(F.col("hot_host").isNull()).drop("hot_host").join(known.select("host", "rate", "certainty"), "host")
    many = rows.join(F.broadcast(hot), "host")
    names = ["page_id", "host", "path", "hit", "rate", "certainty"]
    judged = few.select(names).unionByName(many.select(names))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("certainty") >= reputation.certainty, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "rate", "certainty")
