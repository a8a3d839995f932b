"""Operator 1: host reputation by empirical Bayes, filtering urls by a posterior bound.

Rules judge the pages they fit; those verdicts are the labelled outcomes. The blocked share of a
host is shrunk towards that of its registered domain, the domain's towards its suffix, the suffix's
towards all pages: at each level the parent's posterior mean is the mean of a beta prior for its
children. The prior's strength is fitted to the level by the moments of the beta-binomial: with
``n`` outcomes and a true rate that varies between siblings with correlation ``rho``, the spread of
the observed shares exceeds the binomial one by ``(n - 1) rho``. A page without a rule is blocked
if the lower bound of its host's posterior (mean less ``Z`` standard deviations) exceeds ``LIMIT``.

Suffixes of several labels, such as those of a public suffix list, come as a table with the column
``suffix``; without it the suffix is the last label. The levels are stored, since each is read more
than once.

Everything is a grouping with partial sums and a join by host, domain or suffix.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and gets
the prior of all pages; repeated rows count as outcomes of their own and get equal verdicts; without
any outcome the rate is ``START`` and pages are allowed if it is below ``LIMIT``; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.llm.jaccard import small_or_shuffled
from seqtables.llm.tables import stored

# Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z = 1.645
LIMIT = 0.5
# Share of blocked pages before any outcome, and outcomes it counts for.
START, WEIGHT = 0.1, 2.0
# Bounds of the fitted correlation, so that a prior is neither infinitely strong nor empty.
LEAST_RHO, MOST_RHO = 0.001, 0.9


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does. Rules are few."""
    name = verdict = F.lit(None).cast("string")
    for decided, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, decided).otherwise(verdict)
    return name, verdict


def tail_of(n: Column) -> Column:
    """The last ``n`` labels of ``host``."""
    return F.call_function("substring_index", F.col("host"), F.lit("."), -n)


def registered(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (one row each) with the ``domain`` and ``suffix`` of their ``host``.

    The suffix is the longest tail of whole labels in the column ``suffix`` of ``suffixes``, else the
    last label; the domain has one label more. A host that is a suffix is its own domain.
    """
    labels = F.split("host", "[.]")
    plain = hosts.withColumn("_long", F.lit(1))
    if suffixes is not None:
        known = suffixes.select(F.translate("suffix", UPPER, LOWER).alias("_tail"))
        known = stored(known.filter("_tail IS NOT NULL").distinct(), "host-suffixes")
        sizes = F.sequence(F.lit(1), F.size(labels))
        tails = hosts.select("host", F.explode(sizes).alias("_long")).withColumn(
            "_tail", tail_of(F.col("_long"))
        )
        longest = tails.join(small_or_shuffled(known), "_tail", "left_semi")
        longest = longest.groupBy("host").agg(F.max("_long").alias("_long"))
        plain = hosts.join(longest, "host", "left").withColumn("_long", F.coalesce("_long", F.lit(1)))
    return plain.select(
        *hosts.columns,
        tail_of(F.col("_long") + 1).alias("domain"),
        tail_of(F.col("_long")).alias("suffix"),
    )


def shrink(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """``children`` (bad, n and the parent's key) with their posterior ``a`` and ``b``."""
    known = children.join(parents.select(parent, F.col("mean").alias("prior")), parent)
    spread = F.col("prior") * (1 - F.col("prior"))
    share = F.col("bad") / F.col("n") - F.col("prior")
    # One row: the moments of the level.
    moments = known.filter("n > 0").agg(
        F.sum(F.col("n") * share * share).alias("seen"),
        F.sum(spread).alias("binomial"),
        F.sum((F.col("n") - 1) * spread).alias("over"),
    )
    rho = F.when(
        F.col("over") > 0, (F.col("seen") - F.col("binomial")) / F.col("over")
    ).otherwise(MOST_RHO)
    rho = F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), rho))
    strength = moments.select((1 / F.coalesce(rho, F.lit(MOST_RHO)) - 1).alias("strength"))
    return known.join(F.broadcast(strength)).select(
        *children.columns,
        (F.col("bad") + F.col("strength") * F.col("prior")).alias("a"),
        (F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))).alias("b"),
    ).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def reputations(outcomes: DataFrame, suffix_table: DataFrame | None = None) -> DataFrame:
    """``(host, n, mean, low)`` from rows of ``(host, bad)`` where ``bad`` is 0, 1 or null."""
    counted = outcomes.groupBy("host").agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("n")
    )
    # Each level is read for its parent's sums, its moments and its posteriors.
    hosts = stored(registered(counted, suffix_table), "host-outcomes")
    sums = F.sum("bad").alias("bad"), F.sum("n").alias("n")
    domains = stored(hosts.groupBy("domain", "suffix").agg(*sums), "domain-outcomes")
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("root", F.lit(0))
    suffixes = stored(suffixes, "suffix-outcomes")
    root = suffixes.groupBy("root").agg(
        ((F.sum("bad") + START * WEIGHT) / (F.sum("n") + WEIGHT)).alias("mean")
    )
    suffixes = stored(shrink(suffixes, root, "root"), "suffix-rates")
    domains = stored(shrink(domains, suffixes, "suffix"), "domain-rates")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1))
    return shrink(hosts, domains, "domain").select(
        "host", "n", "mean", (F.col("mean") - Z * sd).alias("low")
    )


def judge_urls(
    pages: DataFrame, page_id: str, url: str, rules=RULES, suffix_table: DataFrame | None = None
) -> DataFrame:
    """One row for each page with its rule and verdict, the rule's or that of the posterior bound."""
    host, path = host_and_path(F.coalesce(F.col(url), F.lit("")))
    placed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = placed.withColumns({"rule": rule, "ruled": verdict})
    bad = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("long"))
    known = reputations(ruled.select("host", bad.alias("bad")), suffix_table)
    by_bound = F.when(F.round("low", 9) > LIMIT, "block").otherwise("allow")
    return ruled.join(known, "host").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", by_bound).alias("verdict"),
        F.col("n").alias("host_outcomes"),
        F.round("mean", 6).alias("block_rate"),
        F.round("low", 6).alias("block_bound"),
    )
