"""Empirical-Bayes host reputation: labelled page outcomes shrunk from host to registered domain to suffix.

A host's share of bad pages has a beta prior around its domain's share, the domain's around its suffix's, the suffix's
around that of all pages. How tightly each level keeps to the one above comes from the data by the method of moments.
A host without outcomes has its domain's share, else its suffix's, else that of all pages, and all the uncertainty between. A host is blocked if even the lower posterior bound of its bad share is over a limit; explicit rules come first.
Only built-in column functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymill.runtime import cut

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz", "co.za")
LIMIT = 0.25  # share of bad pages that a host must surely exceed
Z = 1.645  # of the one-sided 95 % bound
LEAST_SPREAD, MOST_SPREAD = 0.0005, 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffix_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def _weight(level: DataFrame, parent_mean: Column) -> float:
    """Prior strength (pages) of the level above, by the method of moments over (n, bad) of the level's members."""
    rate, var = F.col("bad") / F.col("n"), parent_mean * (1 - parent_mean)
    got = level.agg(
        F.sum(F.col("n") * (rate - parent_mean) * (rate - parent_mean)).alias("s"), F.sum(var).alias("v"), F.sum(var * (F.col("n") - 1)).alias("w")
    ).first()
    spread = (got["s"] - got["v"]) / got["w"] if got["w"] else LEAST_SPREAD
    return 1 / min(max(spread, LEAST_SPREAD), MOST_SPREAD) - 1


def bad_bounds(outcomes: DataFrame, z: float = Z, suffixes: Sequence[str] = LONG_SUFFIXES, hosts: DataFrame | None = None) -> DataFrame:
    """``host, bad_bound``: lower posterior bound of the share of bad pages, for hosts with outcomes and for ``hosts`` (``host``).

    ``outcomes``: ``host, n, bad`` (pages judged, of them bad), any number of rows per host. Hosts that are null or empty
    are left out; without any outcome there is no bound. ``suffixes`` names the public suffixes of two labels; the default is
    a short list, larger lists are the caller's. Only four numbers pass through the driver. The bound is the
    posterior mean less ``z`` standard deviations, at least 0. The variance of a host without outcomes adds up over the levels
    between it and the first with outcomes: a share 1 - product of (1 - 1 / (strength + 1)) of mean * (1 - mean).
    """
    named = lambda df: df.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    known = outcomes.where((F.col("host") != "") & (F.col("n") > 0)).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    known = cut(named(known))
    total = known.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = F.lit(((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0))
    rest = lambda strength: 1 - 1 / (strength + 1)

    level = cut(known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    ks = F.lit(_weight(level, overall))
    of_suffix = level.select(F.col("suffix").alias("_s"), ((F.col("bad") + ks * overall) / (F.col("n") + ks)).alias("suffix_mean"), rest(F.col("n") + ks).alias("_rs"))

    level = known.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    level = cut(level.join(of_suffix, F.col("suffix") == F.col("_s")))
    kd = F.lit(_weight(level, F.col("suffix_mean")))
    of_domain = cut(level.select(F.col("domain").alias("_d"), ((F.col("bad") + kd * F.col("suffix_mean")) / (F.col("n") + kd)).alias("domain_mean"), rest(F.col("n") + kd).alias("_rd")))

    placed = cut(known.join(of_domain, F.col("domain") == F.col("_d")))
    kh = F.lit(_weight(placed, F.col("domain_mean")))
    below = lambda mean, share: F.greatest(mean - z * F.sqrt(mean * (1 - mean) * share), F.lit(0.0)).alias("bad_bound")
    mean = (F.col("bad") + kh * F.col("domain_mean")) / (F.col("n") + kh)
    out = placed.select("host", below(mean, 1 / (F.col("n") + kh + 1)))
    if hosts is None or not total["n"]:
        return out
    new = named(hosts.where(F.col("host") != "").select("host").distinct().join(known.select(F.col("host").alias("_h")), F.col("host") == F.col("_h"), "left_anti"))
    new = new.join(of_domain, F.col("domain") == F.col("_d"), "left").join(of_suffix, F.col("suffix") == F.col("_s"), "left")
    mean = F.coalesce("domain_mean", "suffix_mean", overall)
    kept = F.coalesce("_rd", rest(kd) * F.coalesce("_rs", rest(ks)))
    return out.unionByName(new.select("host", below(mean, 1 - rest(kh) * kept)))


def _rules_of(hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``_rh, rules``: the rules whose host is the row's host or a parent of it, longest first."""
    table = hosts.sparkSession.createDataFrame([(h, p, v) for h, p, v in rules], "_rule_host string, rule_path string, rule_verdict string")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host", F.explode(parents).alias("_parent"))
    met = each.join(table, F.col("_parent") == F.col("_rule_host"))
    name = F.concat("_rule_host", "rule_path")
    entry = F.struct((-F.length(name)).alias("order"), name.alias("rule"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"))
    return met.groupBy(F.col("host").alias("_rh")).agg(F.sort_array(F.collect_set(entry)).alias("rules"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (), limit: float = LIMIT, z: float = Z, suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    ``rules``: (host, path, 'allow' or 'block'). A rule fits its host and all subdomains if the url's path starts with
    the rule's; of several the longest wins (of equally long ones the first by name). Without a rule a page is blocked if
    its host's ``bad_bound`` is over ``limit``, else allowed; empty hosts and null urls are allowed, and so is all without outcomes.
    Repeated rows stay, extra columns are left out, an empty table gives no row.

    Rules and bounds are looked up once per distinct host; the host table is a written table, so a host with very many
    pages is split like any hot key.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("_n")).drop("_n"))
    bounds = cut(bad_bounds(outcomes, z, suffixes, hosts).withColumnRenamed("host", "_bh"))
    table = hosts.join(bounds, F.col("host") == F.col("_bh"), "left")
    fitting = cut(_rules_of(hosts, rules))
    table = cut(table.join(fitting, F.col("host") == F.col("_rh"), "left").select(F.col("host").alias("_h"), "bad_bound", "rules"))
    found = rows.join(table, F.col("host") == F.col("_h"), "left")
    first = F.try_element_at(F.filter(F.coalesce("rules", F.array()), lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))
    own = F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("_first", first).select(
        "page_id", "host", "path", F.col("_first.rule").alias("rule"), F.coalesce(F.col("_first.verdict"), own).alias("verdict")
    )


def outcomes_from_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, n, bad`` of pages whose document has a quality label; a page names its document in its path, as
    ``/<language>/<number>``. A document with contradicting labels counts as bad. Pages are counted before the join."""
    number = F.regexp_extract(path_of(F.col("url")), "^/[a-z]+/([0-9]{1,18})", 1)
    named = pages.select(host_of(F.col("url")).alias("host"), number.alias("_no")).where(F.col("_no") != "")
    counted = cut(named.groupBy("host", F.col("_no").cast("long").alias("_no")).agg(F.count(F.lit(1)).alias("n")))
    judged = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(F.min("quality").alias("_q"))
    met = counted.join(cut(judged), F.col("_no") == F.col("_doc"))
    bad = F.when(F.col("_q") == 0, F.col("n")).otherwise(F.lit(0))
    return met.groupBy("host").agg(F.sum("n").alias("n"), F.sum(bad).alias("bad"))
