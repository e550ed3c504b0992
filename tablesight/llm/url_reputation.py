"""URL filter by empirical-Bayes host reputation, below fixed rules.

Labelled page outcomes are counted per host, registered domain, suffix and over all. From each level
to the next narrower one a beta-binomial prior carries the share of good pages: its mean is the
parent's own posterior mean, its strength (the number of pages it counts for) is estimated per level by
the method of moments from how far children differ from their parents. A host without outcomes so
inherits its domain's or suffix's standing. A page is blocked only if its host's posterior share of
good pages lies below ``LEAST_GOOD`` with the confidence of ``Z``, that is by the posterior's upper
bound, so a thin record blocks nothing.

Outcomes are reduced to counts per host before any join; rules are matched once per host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesight.plans.shared import stored

#: Suffixes under which names are registered, longest match first; others end at their last dot.
SUFFIXES = ("example.com", "example.net", "example.org", "co.uk", "org.uk", "com.au", "co.jp", "com.br")
#: Rules (verdict, prefix of host and path); a rule fits its host and all subdomains.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
#: Least share of good pages, the bound's distance in posterior deviations, bounds of a prior's strength.
LEAST_GOOD = 0.7
Z = 1.645
STRENGTHS = (2.0, 500.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """The host of a url as it stands, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """The path of a url up to ``?`` or ``#``; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest listed suffix of a host, else what follows its last dot, or the host without a dot."""
    found = F.element_at(F.split(name, r"\."), -1)
    for known in sorted(suffixes, key=len):
        found = F.when((name == known) | name.endswith(f".{known}"), known).otherwise(found)
    return found


def registered_domain(name: Column, ending: Column) -> Column:
    """The label before the suffix with the suffix; the host itself where it is no longer than that."""
    before = F.substring_index(F.substring(name, F.lit(1), F.length(name) - F.length(ending) - 1), ".", -1)
    return F.when(F.length(name) > F.length(ending) + 1, F.concat_ws(".", before, ending)).otherwise(name)


def _shrunk(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``children`` (own key, ``key``, n, good) with mean and strength of the posterior under ``parents``' means.

    The strength s of the level is the one whose expected squared distance of child shares from parent
    means, m(1-m)(s+n)/(s+1)/n summed over children with outcomes, equals the one found.
    """
    joined = children.join(parents.select(key, F.col("mean").alias("prior")), key)
    seen = F.col("n") > 0
    spread = F.col("prior") * (1 - F.col("prior"))
    share = F.col("good") / F.when(seen, F.col("n"))
    sums = joined.where(seen).agg(
        F.sum(F.pow(share - F.col("prior"), 2)).alias("found"), F.sum(spread / F.col("n")).alias("sampling"), F.sum(spread).alias("whole"),
    ).first()
    between = min(max(((sums["found"] or 0.0) - (sums["sampling"] or 0.0)) / max((sums["whole"] or 0.0) - (sums["sampling"] or 0.0), 1e-9), 1e-9), 1.0)
    strength = F.lit(float(min(max(1 / between - 1, STRENGTHS[0]), STRENGTHS[1])))
    mean = (F.col("good") + strength * F.col("prior")) / (F.col("n") + strength)
    return joined.withColumn("mean", mean).withColumn("weight", F.col("n") + strength).drop("prior")


def reputations(hosts: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior per row of ``hosts`` (host, distinct): mean, bound and outcome count n.

    ``outcomes`` has host, n and good. With no outcomes at all every mean is one.
    """
    counted = hosts.join(outcomes, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
    ending = suffix(F.col("host"), suffixes)
    leaves = stored(counted.withColumn("suffix", ending).withColumn("domain", registered_domain(F.col("host"), F.col("suffix"))), "hosts")
    total = leaves.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    every = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 1)
    top = leaves.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("root", F.lit(1))
    root = hosts.sparkSession.createDataFrame([(1, every)], "root int, mean double")
    tops = stored(_shrunk(top, root, "root"), "suffixes")
    middle = leaves.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    middles = stored(_shrunk(middle, tops, "suffix"), "domains")
    found = _shrunk(leaves, middles, "domain")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return found.select("host", "n", "mean", (F.col("mean") + F.lit(Z) * deviation).alias("bound"))


def host_rules(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``host`` and ``rules``: the rules (rule, path, verdict) that fit the host, longest first; hosts without are left out."""
    frame = hosts.sparkSession.createDataFrame(
        [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, v) for v, r in rules], "fits string, path string, rule string, verdict string",
    )
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = hosts.select("host", F.explode(tails).alias("fits")).join(frame, "fits")
    return fitting.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "path", "verdict")), asc=False).alias("rules"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, suffixes: Sequence[str] = SUFFIXES, least_good: float = LEAST_GOOD) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, reputation and its bound.

    ``outcomes`` (page_id, good 0 or 1) holds labelled pages; null ids and other values are left out. A page
    id counts once for a host, however often it or its label is repeated, and as good only if all its
    labels are. Every row of ``pages`` is judged, repeated ones alike. A null url, or one without ``://``, has empty host and path; such pages form a host of their own.
    Other columns are not read.
    """
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = outcomes.where("page_id is not null and good in (0, 1)").groupBy("page_id").agg(F.min(F.col("good").cast("int")).alias("good"))
    labelled = parts.select("page_id", "host").join(known, "page_id").distinct()
    counted = labelled.groupBy("host").agg(F.count("good").alias("n"), F.sum("good").alias("good"))
    counts = parts.select("host").distinct().join(counted, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
    counts = stored(counts, "host-counts")
    standing = reputations(counts.select("host"), counts, suffixes)
    per_host = standing.join(host_rules(counts.select("host"), rules), "host", "left")
    fits = F.filter(F.coalesce("rules", F.expr("array()")), lambda r: F.col("path").startswith(r["path"]))
    judged = parts.join(stored(per_host, "host-standing"), "host").withColumn("first", F.get(fits, F.lit(0)))
    verdict = F.coalesce("first.verdict", F.when(F.col("bound") < F.lit(least_good), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("first.rule").alias("rule"), verdict.alias("verdict"), F.round("mean", 6).alias("reputation"), F.round("bound", 6).alias("bound"))


def oracle() -> str:
    """DuckDB SQL for ``judge`` of ``pages`` with the labels' quality as outcomes and the settings above."""
    endings = " ".join(f"when host = '{s}' or ends_with(host, '.{s}') then '{s}'" for s in sorted(SUFFIXES, key=len, reverse=True))
    values = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for v, r in RULES)

    def level(name: str, children: str, parents: str, key: str) -> str:
        return f"""
        {name}_j as materialized (select c.*, p.mean as prior, c.good / nullif(c.n, 0) as share from {children} c join {parents} p using ({key})),
        {name}_s as materialized (
            select least(greatest(1 / b - 1, {STRENGTHS[0]}), {STRENGTHS[1]}) as strength from (
                select least(greatest((coalesce(sum((share - prior) ** 2), 0) - coalesce(sum(prior * (1 - prior) / n), 0))
                    / greatest(coalesce(sum(prior * (1 - prior)), 0) - coalesce(sum(prior * (1 - prior) / n), 0), 1e-9), 1e-9), 1.0) as b
                from {name}_j where n > 0)),
        {name} as materialized (select j.*, (good + strength * prior) / (n + strength) as mean, n + strength as weight from {name}_j j, {name}_s)"""

    return f"""
        with parts as materialized (
            select page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
                   coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
        known as (select doc_id as page_id, min(quality) as good from labels where doc_id is not null and quality in (0, 1) group by doc_id),
        counted as (select host, count(*) as n, sum(good) as good from (select distinct page_id, host from parts) join known using (page_id) group by host),
        counts as (select host, coalesce(n, 0) as n, coalesce(good, 0) as good from (select distinct host from parts) left join counted using (host)),
        endings as (select *, case {endings} else split_part(host, '.', -1) end as suffix from counts),
        leaves as materialized (
            select *, case when length(host) > length(suffix) + 1
                           then split_part(left(host, length(host) - length(suffix) - 1), '.', -1) || '.' || suffix else host end as domain
            from endings),
        root as (select 1 as root, (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 1) as mean from leaves),
        top_counts as (select suffix, sum(n) as n, sum(good) as good, 1 as root from leaves group by suffix),
        {level("tops", "top_counts", "root", "root")},
        middle_counts as (select domain, suffix, sum(n) as n, sum(good) as good from leaves group by all),
        {level("middles", "middle_counts", "tops", "suffix")},
        {level("hosts", "leaves", "middles", "domain")},
        rules(fits, prefix, rule, verdict) as (values {values}),
        fitting as (
            select p.page_id, max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) as first
            from parts p join rules r on (p.host = r.fits or ends_with(p.host, '.' || r.fits)) and starts_with(p.path, r.prefix) group by p.page_id)
        select p.page_id, p.host, p.path, f.first.rule as rule,
               coalesce(f.first.verdict, case when h.mean + {Z} * sqrt(h.mean * (1 - h.mean) / (h.weight + 1)) < {LEAST_GOOD} then 'block' else 'allow' end) as verdict,
               round(h.mean, 6) as reputation, round(h.mean + {Z} * sqrt(h.mean * (1 - h.mean) / (h.weight + 1)), 6) as bound
        from parts p join hosts h using (host) left join fitting f using (page_id)"""
