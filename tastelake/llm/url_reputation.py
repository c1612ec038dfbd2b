"""Host reputation by beta-binomial shrinkage, and URL rules (operator 8). DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tastelake.session import materialise

#: (host, path prefix, verdict)
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The registered domain: one label and the suffix. ``suffixes`` names public suffixes of two labels."""
    longer = F.substring_index(host, ".", -2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(longer, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    longer = F.substring_index(host, ".", -2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(longer, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits the host or a domain above it and the start of the path."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def _shrunk(children: DataFrame, parent: DataFrame, parent_key: str, least: float, most: float) -> tuple[DataFrame, float]:
    """Mean of each child shrunk to its parent's, and the prior's strength by moments over all children."""
    joined = children.join(parent.select(F.col(parent_key).alias("_p"), F.col("mean").alias("_mean")),
                           F.col(parent_key) == F.col("_p"), "left")
    rate = F.col("good") / F.col("n")
    # of a beta-binomial: weighted squares about the parent's mean = sum m(1-m)(1 + (n-1)/(s+1))
    base = F.col("_mean") * (1 - F.col("_mean"))
    moments = joined.agg(F.sum(F.round(F.col("n") * (rate - F.col("_mean")) ** 2, 9)).alias("q"), F.sum(F.round(base, 9)).alias("b"),
                         F.sum(F.round(base * (F.col("n") - 1), 9)).alias("r"))
    rho = F.when(F.col("r") > 0, (F.col("q") - F.col("b")) / F.col("r")).otherwise(0.0)
    strength = moments.select(F.coalesce(F.when(rho <= 1 / (most + 1), F.lit(most)).when(rho >= 1 / (least + 1), F.lit(least))
                                         .otherwise(1 / rho - 1), F.lit(most))).first()[0]  # one number
    done = joined.withColumns({
        "a": strength * F.col("_mean") + F.col("good"),
        "b": strength * (1 - F.col("_mean")) + F.col("n") - F.col("good"),
    }).withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))).drop("_p", "_mean")
    return done, strength


class Reputation(NamedTuple):
    """``hosts``: host, domain, suffix, n, good, posterior Beta(a, b), mean. ``domains`` and ``ends`` (suffixes): alike. ``overall``: the
    mean of all, null without labels. ``spread``: the correlation 1 / (strength + 1) inside a group of hosts, of domains, of suffixes."""
    hosts: DataFrame
    domains: DataFrame
    ends: DataFrame
    overall: float | None
    spread: tuple[float, float, float]

    def strength(self, levels: int) -> float:
        """Of the prior of a host whose nearest known group is so many levels up: the spreads of the levels add up."""
        left = 1.0
        for rho in self.spread[:levels]:
            left *= 1 - rho
        return left / (1 - left)


def reputation(outcomes: DataFrame, suffixes: Sequence[str] = (), least: float = 1.0, most: float = 1000.0) -> Reputation:
    """Posteriors of labelled hosts, and what the prior of all others needs.

    :param outcomes: host, good (boolean), one row per labelled page.
    :param least, most: bounds of the priors' strength in pages.

    Counts go up from host to registered domain to suffix to all; means come down again, each level shrunk to the
    one above with a strength found from all its groups. Rows with a null host or outcome are not used.
    """
    hosts = (outcomes.filter(F.col("host").isNotNull() & F.col("good").isNotNull()).groupBy("host")
             .agg(F.count("*").cast("double").alias("n"), F.sum(F.col("good").cast("double")).alias("good"))
             .withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    hosts = materialise(hosts, "hosts")  # read at each level; one row per host
    total = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = materialise(hosts.groupBy("domain", "suffix").agg(*total), "domains")
    ends = materialise(domains.groupBy("suffix").agg(*total).withColumn("all", F.lit("all")), "suffixes")
    top = materialise(ends.agg(*total).select(F.lit("all").alias("all"), ((F.col("good") + 1) / (F.col("n") + 2)).alias("mean")), "overall")
    ends, by_suffix = _shrunk(ends, top, "all", least, most)
    ends = materialise(ends, "suffix-means")
    domains, by_domain = _shrunk(domains, ends, "suffix", least, most)
    domains = materialise(domains, "domain-means")
    hosts, by_host = _shrunk(hosts, domains, "domain", least, most)
    return Reputation(hosts.select("host", "domain", "suffix", "n", "good", "a", "b", "mean"), domains, ends, top.first()["mean"],
                      tuple(1 / (s + 1) for s in (by_host, by_domain, by_suffix)))


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], suffixes: Sequence[str] = (),
           threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and bound.

    :param pages: needs ``url``; columns named like the new ones are replaced.
    :param outcomes: host, good: labelled pages.
    :param threshold: a host without rule is blocked if even the upper posterior bound of its share of good pages,
        mean + z standard deviations, is below.

    A host without labelled page is judged by its prior: the mean of its domain, else of its suffix, else of all hosts, with the strength
    found for hosts around it. Without any label all hosts are allowed. A null url, or one without ``://``, has an empty
    host and path and is judged by the reputation of the empty host. Repeated rows stay, judged alike.
    """
    new = {"host", "path", "rule", "verdict", "bound"}
    base = pages.select(*[c for c in pages.columns if c not in new], host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    known = reputation(outcomes, suffixes)

    def bound(a: Column, b: Column) -> Column:
        return a / (a + b) + z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))

    def prior(mean: str, levels: int) -> Column:
        s = F.lit(known.strength(levels))
        return bound(s * F.col(mean), s * (1 - F.col(mean)))

    by_host = known.hosts.select("host", bound(F.col("a"), F.col("b")).alias("_h"))
    by_domain = known.domains.select(F.col("domain").alias("_domain"), F.col("mean").alias("_d"))
    by_suffix = known.ends.select(F.col("suffix").alias("_suffix"), F.col("mean").alias("_s"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    # every host once, so the pages themselves are joined by host alone
    hosts = (base.select("host").distinct().withColumns({"_domain": domain_of(F.col("host"), suffixes), "_suffix": suffix_of(F.col("host"), suffixes)})
             .join(by_host, "host", "left")
             .join(by_domain, "_domain", "left").join(by_suffix, "_suffix", "left")
             .withColumn("_t", F.lit(known.overall).cast("double"))
             .select("host", F.coalesce("_h", prior("_d", 1), prior("_s", 2), prior("_t", 3)).alias("bound")))
    out = base.join(materialise(hosts, "host-bounds"), "host", "left")
    upper = F.col("bound")
    method = F.when(F.round(upper, 9) < threshold, "block").otherwise("allow")
    return out.select(*base.columns, rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), upper.alias("bound"))
