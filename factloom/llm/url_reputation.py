"""URL filter: path rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host and rolled up to registered domain, suffix and all.
Each level shrinks towards the posterior mean of the level above through a beta-binomial prior; how
strongly is estimated from the data as an intra-class correlation, out of whole-number pair counts:
two outcomes of one child agree more often than two of different children of one parent.  A host
passes if the lower posterior bound of its share of good pages reaches a threshold.

Pages and labels meet once, in counts that are written, one row per host; pages travel once, with their host, to the one row of
that host in an equi-join that the adaptive planner splits where a host is hot.  Three times four
sums, whatever the input, go through the driver.

Null or odd urls have an empty host and path; an empty host is judged like any other.  Outcomes with
null value or id count for nothing, repeated outcomes count each time.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower, own
from factloom.session import stage

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "co.nz", "com.br", "co.in", "co.za")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the host and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """Lower bound = posterior mean - z standard deviations; strengths are kept within two bounds."""

    threshold: float = 0.5
    z: float = 1.645
    least_strength: float = 1.0
    most_strength: float = 1000.0


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two if they are a known suffix; empty for an address of digits."""
    name = _name(host)
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    return (
        F.when(name.rlike(r"^[0-9.]*$"), "")
        .when(two.isin(*TWO_LABEL_SUFFIXES), two)
        .otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    )


def domain_of(host: Column) -> Column:
    """The suffix and one label before it; the whole host if there is none."""
    name = _name(host)
    two, three = (F.regexp_extract(name, rf"((?:[^.]+\.){{{n}}}[^.]+)$", 1) for n in (1, 2))
    own_two = F.when(two == "", name).otherwise(two)
    return (
        F.when(name.rlike(r"^[0-9.]*$"), name)
        .when(two.isin(*TWO_LABEL_SUFFIXES), F.when(three == "", name).otherwise(three))
        .otherwise(own_two)
    )


def _name(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _agreement(children: DataFrame, parent: str) -> tuple:
    """Pairs of outcomes of one child, and of different children of one parent: all, and both good."""
    wide = "decimal(38,0)"
    k, n = F.col("k").cast(wide), F.col("n").cast(wide)
    per_parent = children.groupBy(parent).agg(
        F.sum(k).alias("pk"),
        F.sum(n).alias("pn"),
        F.sum((k * k).cast(wide)).alias("kk"),
        F.sum((n * n).cast(wide)).alias("nn"),
    )
    zero = F.lit(0).cast(wide)
    row = per_parent.agg(
        *(
            F.coalesce(F.sum(c.cast(wide)), zero)
            for c in (
                F.col("kk") - F.col("pk"),
                F.col("nn") - F.col("pn"),
                F.col("pk") * F.col("pk") - F.col("kk"),
                F.col("pn") * F.col("pn") - F.col("nn"),
                F.col("pk"),
                F.col("pn"),
            )
        )
    ).first()
    return tuple(int(x) for x in row)


def strength(agreement: tuple, how: Reputation) -> float:
    """Prior strength a + b: (1 - r) / r for the correlation r of outcomes within a child."""
    same_good, same, mixed_good, mixed, good, total = (float(x) for x in agreement)
    if same == 0 or mixed == 0:
        return how.most_strength
    p_same, p_mixed, mean = same_good / same, mixed_good / mixed, good / total
    if p_same <= p_mixed:
        return how.most_strength
    return min(how.most_strength, max(how.least_strength, (mean - p_same) / (p_same - p_mixed)))


def host_reputation(outcomes: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """One row per host of (host, k good, n labelled): posterior mean and lower bound.

    ``outcomes`` has a row per host; hosts without labels get what their domain says.
    """
    hosts = outcomes.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    sums = [F.sum("k").alias("k"), F.sum("n").alias("n")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("all", F.lit(0))
    levels = [_agreement(suffixes, "all"), _agreement(domains, "suffix"), _agreement(hosts, "domain")]
    by_suffix, by_domain, by_host = (F.lit(strength(x, how)) for x in levels)
    root = F.lit((levels[0][4] + 1.0) / (levels[0][5] + 2.0))

    def shrunk(prior: Column, weight: Column) -> Column:
        return (F.col("k") + weight * prior) / (F.col("n") + weight)

    suffix_means = suffixes.select("suffix", shrunk(root, by_suffix).alias("suffix_mean"))
    domain_means = domains.join(suffix_means, "suffix").select(
        "domain", "suffix", shrunk(F.col("suffix_mean"), by_domain).alias("prior")
    )
    a = F.col("k") + by_host * F.col("prior")
    total = F.col("n") + by_host
    mean = a / total
    return (
        hosts.join(domain_means, ["domain", "suffix"])
        .select("host", "n", mean.alias("mean"), total.alias("total"))
        .withColumn(
            "lower_bound",
            F.col("mean") - how.z * F.sqrt(F.col("mean") * (1.0 - F.col("mean")) / (F.col("total") + 1.0)),
        )
        .select("host", F.col("n").alias("n_labelled"), "mean", "lower_bound")
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    how: Reputation = Reputation(),
    page_id: str = "page_id",
    url: str = "url",
    outcome_id: str = "doc_id",
    good: str = "quality",
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's posterior mean and lower bound."""
    page = own(pages, page_id=page_id, url=url)
    page = page.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = own(outcomes, outcome_id=outcome_id, good=good).where("outcome_id is not null and good is not null")
    counts = (
        page.select("page_id", "host")
        .join(known, page["page_id"] == known["outcome_id"], "left")
        .groupBy("host")
        .agg(
            F.coalesce(F.sum(F.when(F.col("good") > 0, 1).when(F.col("good").isNotNull(), 0)), F.lit(0)).alias("k"),
            F.count("good").alias("n"),
        )
    )
    counts = stage(counts, "host-counts")  # read four times: one join of pages and labels, one row per host
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own_verdict = F.when(F.col("lower_bound") >= how.threshold, "allow").otherwise("block")
    return page.join(host_reputation(counts, how), "host", "left").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(said, own_verdict).alias("verdict"),
        "mean",
        "lower_bound",
    )
