"""URL filter: rules first, then an empirical-Bayes reputation of the host. DataFrame functions only.

Pages that a rule decides are the labelled outcomes (or a table of outcomes is given). A host with
few of them says little, so its rate is shrunk towards its registered domain, the domain's towards
its suffix and the suffix's towards the whole, by beta-binomial priors whose strength is estimated
at each level from how far the rates of its members spread. A page is blocked when the lower bound of its
host's posterior lies above the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillsift.session import materialise

# Verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z = 1.645
THRESHOLD = 0.5
# Correlation of outcomes inside a group: 1 / (prior strength + 1). Limits of the estimate, and its
# value where nothing can be estimated.
RHO_MIN, RHO_MAX, RHO_DEFAULT = 0.001, 0.9, 0.2


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The registered domain: one label more than the suffix. ``suffixes`` names those of two labels."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two) if suffixes else two


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def shrunk_rates(groups: DataFrame, parents: DataFrame, parent_key: str, keep_prior: bool = False) -> DataFrame:
    """Adds ``_strength`` and ``_mean`` to groups (_n, _bad), whose parents have ``_mean``.

    The prior's strength, one number, comes from one aggregate over all groups with outcomes: the weighted spread
    of their rates about their parents' means against what binomial noise alone would give.
    """
    joined = groups.join(parents.select(parent_key, F.col("_mean").alias("_prior")), parent_key, "left")
    seen = F.col("_n") > 0
    n, var = F.col("_n").cast("double"), F.col("_prior") * (1 - F.col("_prior"))
    spread = F.when(seen, n * F.pow(F.col("_bad") / n - F.col("_prior"), 2) / var)
    moments = joined.agg(
        F.count(F.when(seen, 1)).alias("_k"), F.sum(n).alias("_total"), F.sum(n * n).alias("_squares"),
        F.sum(spread).alias("_spread"),
    )
    room = F.col("_total") - F.col("_squares") / F.col("_total") - (F.col("_k") - 1)
    rho = F.when((F.col("_k") < 2) | (room <= 0), F.lit(RHO_DEFAULT)).otherwise(
        F.least(F.greatest((F.col("_spread") - (F.col("_k") - 1)) / room, F.lit(RHO_MIN)), F.lit(RHO_MAX)))
    strength = moments.select(F.coalesce((1 - rho) / rho, F.lit((1 - RHO_DEFAULT) / RHO_DEFAULT))).first()[0]
    out = joined.withColumn("_strength", F.lit(float(strength))).withColumn(
        "_mean", (F.col("_strength") * F.col("_prior") + F.col("_bad")) / (F.col("_strength") + F.col("_n")))
    return out if keep_prior else out.drop("_prior")


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: Sequence[str] = ()) -> DataFrame:
    """Per host: ``risk``, the posterior mean of a bad page, and ``risk_lower``, its lower bound.

    ``outcomes`` has ``host`` and ``bad``: true, false, or null for pages without a label, whose hosts get
    what their domain and suffix say. Without any label every mean is one half.
    """
    count = lambda what: F.coalesce(F.sum(what), F.lit(0)).cast("long")
    hosts = materialise(outcomes.groupBy("host").agg(
        F.count("bad").alias("_n"), count(F.col("bad").cast("int")).alias("_bad"),
    ).withColumns({"_domain": domain_of(F.col("host"), suffixes), "_suffix": suffix_of(F.col("host"))}))
    up = [F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad")]
    domains = hosts.groupBy("_domain", "_suffix").agg(*up)
    tops = domains.groupBy("_suffix").agg(*up).withColumn("_all", F.lit(0))
    whole = tops.groupBy("_all").agg(*up).withColumn("_mean", (F.col("_bad") + 1) / (F.col("_n") + 2))
    tops = shrunk_rates(tops, whole, "_all")
    domains = shrunk_rates(domains, tops.drop("_strength"), "_suffix")
    hosts = shrunk_rates(hosts, domains.drop("_strength", "_suffix"), "_domain")
    mean = F.col("_mean")
    width = F.sqrt(mean * (1 - mean) / (F.col("_strength") + F.col("_n") + 1))
    return hosts.select("host", mean.alias("risk"), (mean - z * width).alias("risk_lower"))


def judge_urls(pages: DataFrame, url_column: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
               threshold: float = THRESHOLD, z: float = Z, suffixes: Sequence[str] = (),
               outcomes: DataFrame | None = None) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule``, ``verdict``, ``risk`` and ``risk_lower``.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is judged like any
    host by its label counts. Repeated rows count as often as they occur. Input columns of the output's names are
    replaced. ``outcomes`` (host, bad) takes the place of the rules' verdicts as labels.
    The label counts meet map-side, so a host with a third of all pages is one row per task in the shuffle;
    in the join back to the pages adaptive execution splits it.
    """
    host, path = url_host(F.col(f"`{url_column}`")), url_path(F.col(f"`{url_column}`"))
    read = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict", "risk", "risk_lower")
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    read = read.withColumns({"rule": rule, "_ruled": verdict})
    labelled = read.select("host", (F.col("_ruled") == "block").alias("bad"))
    if outcomes is not None:
        labelled = outcomes.select("host", "bad").unionByName(
            read.select("host", F.lit(None).cast("boolean").alias("bad")))
    reputation = host_reputation(labelled, z, suffixes)
    method = F.when(F.col("risk_lower") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return read.join(reputation, "host", "left").withColumn("verdict", F.coalesce("_ruled", method)).drop("_ruled")
