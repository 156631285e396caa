"""URL filter: path rules first, then empirical-Bayes host reputation.

Labelled outcomes (bad or not) of pages are counted by host, registered domain and suffix. At each level the rate of
a name is shrunk towards its parent's rate by a beta-binomial prior whose strength is fitted to that level's names by
the method of moments: suffix towards the whole table, domain towards its suffix, host towards its domain. A host is
blocked when the lower bound of its posterior (mean - z * standard deviation) is above the tolerated rate; a host
never seen with a label gets its domain's posterior, and so on upwards.

All built-in functions. Outcomes are counted once by host, as partial sums, so a host with a third of the pages is no
burden; the levels are made from that table of hosts. Ratings go back to the pages by a broadcast if they were counted
to be few, else by a join whose large partitions Spark splits.

Defined cases: a null url or one without :// has an empty host and path, fits no rule and is allowed by the method
(nothing is known of it); a host of one label is its own domain and suffix; urls of any length are read whole; repeated
rows are judged alike and each counts; of rules of the same length the first listed one wins, and a bound that equals
the tolerated rate is allowed; without labelled pages everything outside the rules is allowed; an empty table gives no
row; other columns are ignored and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, UPPER, broadcast_if_small, discard, stored


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]

#: Second-level names that make up a suffix together with a two-letter country name.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
TOLERATED = 0.5
#: Least and greatest strength of a prior, in outcomes.
WEAKEST, STRONGEST = 8.0, 1000.0
Z = 1.6449  # one-sided 95 %


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    parts = F.split(host, r"\.")
    last, second = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    return F.when((F.size(parts) > 2) & (F.length(last) == 2) & second.isin(SECOND_LEVEL), F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    parts = F.split(host, r"\.")
    labels = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - labels + 1), labels), ".")


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, action) of the longest fitting rule, or nulls. Of equally long ones the first listed."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    none = F.lit(None).cast("struct<rule:string,action:string>")
    return none if out is None else out.otherwise(none)


def _level(counts: DataFrame, name: str, parent: str | None, above: DataFrame | None, mean: float) -> DataFrame:
    """(name, n, k, a, b): the counts and the posterior of each name of a level, written to the shared folder.

    above: the parent level's (parent, a, b); without one the prior mean of all names is `mean`. The prior strength
    comes from the method of moments, within 8 and 1000: of names with n outcomes, k bad, around a prior mean p, the
    excess of the weighted squared deviations over binomial noise gives the correlation rho, and 1 / rho - 1 outcomes
    are the strength. Three sums go to the driver.
    """
    keys = [name] if parent is None else [name, parent]
    own = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    if above is None:
        own = own.withColumn("p", F.lit(mean))
    else:
        prior = above.select(parent, (F.col("a") / (F.col("a") + F.col("b"))).alias("p"))
        own = own.join(broadcast_if_small(prior, prior.count()), parent)
    own = stored(own, f"prior-{name}")
    p = F.col("p")
    noise = p * (1 - p)
    s, base, room = own.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, F.lit(2.0))), F.sum(noise), F.sum(noise * (F.col("n") - 1))).first()
    rho = (s - base) / room if room else None
    m = STRONGEST if rho is None or rho <= 0.001 else max(WEAKEST, min(STRONGEST, 1 / rho - 1))
    out = stored(own.select(name, "n", "k", (F.col("k") + m * p).alias("a"), (F.col("n") - F.col("k") + m * (1 - p)).alias("b")), f"posterior-{name}")
    discard(own)
    return out


def reputations(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posteriors (name, n, k, a, b) by host, domain and suffix. outcomes: host, bad (0 or 1), one row a labelled page."""
    by_host = outcomes.where(F.col("host") != "").groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("k")).where("n > 0")
    counts = stored(by_host.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "host-counts")
    n, k = counts.agg(F.sum("n"), F.sum("k")).first()
    suffixes = _level(counts, "suffix", None, None, ((k or 0) + 0.5) / ((n or 0) + 1.0))
    domains = _level(counts, "domain", "suffix", suffixes, 0.0)
    hosts = _level(counts, "host", "domain", domains, 0.0)
    discard(counts)
    return hosts, domains, suffixes


def ratings(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, bad_rate, bad_bound) of every host of pages of which anything is known, written to the shared folder."""
    names = pages.select(host_of(F.col("url")).alias("host")).where(F.col("host") != "").distinct()
    rated = names.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    levels = reputations(outcomes)
    for j, level in enumerate(levels):
        key = level.columns[0]
        rated = rated.join(broadcast_if_small(level.select(key, F.col("a").alias(f"a{j}"), F.col("b").alias(f"b{j}")), level.count()), key, "left")
    rated = rated.select("host", F.coalesce("a0", "a1", "a2").alias("a"), F.coalesce("b0", "b1", "b2").alias("b"))
    n = F.col("a") + F.col("b")
    mean = F.col("a") / n
    out = stored(rated.select("host", mean.alias("bad_rate"), F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (n + 1))).alias("bad_bound")), "host-ratings")
    discard(*levels)
    return out


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule] = RULES, tolerated: float = TOLERATED, z: float = Z) -> DataFrame:
    """One row per row of pages: page_id, url, host, path, rule, verdict, and bad_rate, bad_bound (null if nothing is known)."""
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rated = ratings(pages, outcomes, z).withColumnRenamed("host", "rated_host")
    out = p.join(broadcast_if_small(rated, rated.count()), F.col("host") == F.col("rated_host"), "left").withColumn("fits", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bad_bound") > tolerated, "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce(F.col("fits.action"), own).alias("verdict"), "bad_rate", "bad_bound")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): the pages that show a labelled document, whose number ends their url; bad if its quality is 0 or it is toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html|/)?$", 1).try_cast("bigint")
    p = pages.select(host_of(F.col("url")).alias("host"), number.alias("shown"))
    marks = labels.groupBy(F.col("doc_id").alias("marked")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return p.join(marks.where("bad is not null"), F.col("shown") == F.col("marked")).select("host", "bad")
