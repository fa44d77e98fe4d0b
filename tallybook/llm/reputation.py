"""URL filter: written rules first, then host reputation by empirical Bayes.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix.
Each level has a beta-binomial prior whose mean is its parent's posterior mean and whose
strength comes from how much siblings differ (method of moments, pooled over parents):
siblings that agree make a strong prior, ones that differ a weak one. A host without
outcomes so has its domain's estimate. A host is blocked where the lower posterior bound
of its rate of bad pages exceeds the limit.

Only DataFrame functions are used. Counts merge before the shuffle; the verdict of a host
reaches its pages by a join that is safe for hosts of a third of all pages.

Cases: a null url, or one without `://`, has an empty host and path and matches no rule;
all such urls are one host; labels that are null or name no page play no part, of repeated
labels any bad one holds; repeated pages count and come out as often as they stand; an
empty table gives no rows; result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import checkpointed, join_facts, lower_ascii, table

#: (rule, verdict); a rule is a host, and a path from its first `/` on. Fixed by the result contract.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Suffixes of two labels under which names are registered.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "com.mx", "co.za")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Limits of the share of variance between siblings: priors of 999 to 0.001 pages.
LEAST, MOST = 0.001, 0.999


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(text, URL, 1)), F.regexp_extract(text, URL, 2)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does. Meant for short lists."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def name_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    labels = F.split(host, r"\.")
    pair = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    double = pair.isin(*DOUBLE_SUFFIXES)
    domain = F.when(double, F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3))).otherwise(pair)
    return domain, F.when(double, pair).otherwise(F.element_at(labels, -1))


def _strength(children: DataFrame, parent: str | None) -> float:
    """Prior strength of a level from the rates (n, bad) of its members under their parents."""
    known = children.where("n > 0")
    grouped = known.groupBy(*([parent] if parent else [])).agg(
        F.sum("n").alias("N"), F.sum("bad").alias("K"), F.count("*").alias("J"),
        F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("spread"),
    )
    mean = F.col("K") / F.col("N")
    within = mean * (1 - mean)
    sums = grouped.agg(
        F.sum(F.col("spread") - F.col("N") * mean * mean).alias("S"),
        F.sum(within * (F.col("J") - 1)).alias("A"),
        F.sum(within * (F.col("N") - F.col("squares") / F.col("N"))).alias("B"),
    ).first()
    if sums.S is None or sums.B - sums.A <= 0:
        return 1 / LEAST - 1
    return 1 / min(MOST, max(LEAST, (sums.S - sums.A) / (sums.B - sums.A))) - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, pages, n, bad, rate, lower, upper) of every host of pages (page_id, host).

    outcomes: (page_id, bad) with bad 0 or 1. The bounds are those of the posterior, by its
    mean and variance, z deviations away.
    """
    labelled = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.join(labelled, "page_id", "left").groupBy("host").agg(
        F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    domain, suffix = name_levels(F.col("host"))
    hosts = checkpointed(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = F.lit(whole.bad / whole.n if whole.n else 0.5)
    by_suffix, by_domain, by_host = _strength(suffixes, None), _strength(domains, "suffix"), _strength(hosts, "domain")

    def shrunk(strength: float, prior: Column) -> Column:
        return (F.col("bad") + strength * prior) / (F.col("n") + strength)

    top = suffixes.select("suffix", shrunk(by_suffix, base).alias("prior"))
    middle = domains.join(top, "suffix").select("domain", shrunk(by_domain, F.col("prior")).alias("prior"))
    rated = hosts.join(middle, "domain").withColumn("rate", shrunk(by_host, F.col("prior")))
    width = z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + by_host + 1))
    return rated.select("host", "pages", "n", "bad", "rate", (F.col("rate") - width).alias("lower"), (F.col("rate") + width).alias("upper"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = 0.5
) -> DataFrame:
    """pages with host, path, rule, verdict (block or allow) and the host's rate and lower bound."""
    results = ("host", "path", "rule", "verdict", "rate", "lower")
    host, path = url_parts(F.col("url"))
    split = pages.drop(*results).withColumns({"host": host, "path": path})
    facts = checkpointed(host_reputation(split.select("page_id", "host"), outcomes).select("host", "pages", "rate", "lower"))
    total = facts.agg(F.sum("pages")).first()[0] or 0
    rated = join_facts(split, facts, ["host"], "pages", total)
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("lower") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return rated.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)})


def op2_url_reputation(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages. A page's outcome is the label of its id: bad if low in quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    judged = judge_urls(
        table(spark, sf_dir, "pages").select("page_id", "url"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    )
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, parent: str, key: str) -> str:
    """SQL of a level's prior strength; parent is the table's grouping column or nothing."""
    group = f"group by {parent}" if parent else ""
    return f"""
{name}_sums as (select sum(n) as nn, sum(bad) as kk, count(*) as jj, sum(n * n) as squares,
    sum(bad * bad / cast(n as double)) as spread from {key} where n > 0 {group}),
{name}_parts as (select sum(spread - nn * (kk / cast(nn as double)) * (kk / cast(nn as double))) as s,
    sum((kk / cast(nn as double)) * (1 - kk / cast(nn as double)) * (jj - 1)) as a,
    sum((kk / cast(nn as double)) * (1 - kk / cast(nn as double)) * (nn - squares / cast(nn as double))) as b
    from {name}_sums),
{name} as (select case when s is null or b - a <= 0 then {1 / LEAST - 1}
    else 1 / least({MOST}, greatest({LEAST}, (s - a) / (b - a))) - 1 end as m from {name}_parts)"""


ORACLE = rf"""
with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages),
outcomes as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 when quality is null or toxic is null then null
  else 0 end) as bad from labels group by doc_id),
hosts as (select host, regexp_extract(host, '[^.]*([.][^.]*)?$', 0) as domain, regexp_extract(host, '[^.]*$', 0) as suffix,
  count(bad) as n, coalesce(sum(bad), 0) as bad from parts left join outcomes on page_id = doc_id group by host),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by suffix),
base as (select case when sum(n) > 0 then sum(bad) / cast(sum(n) as double) else 0.5 end as rate from suffixes),
{_level("by_suffix", "", "suffixes")},
{_level("by_domain", "suffix", "domains")},
{_level("by_host", "domain", "hosts")},
top as (select suffix, (bad + by_suffix.m * base.rate) / (n + by_suffix.m) as prior from suffixes, by_suffix, base),
middle as (select domain, (bad + by_domain.m * prior) / (n + by_domain.m) as prior
  from domains join top on domains.suffix = top.suffix, by_domain),
rated as (select host, n, by_host.m as m, (bad + by_host.m * prior) / (n + by_host.m) as rate
  from hosts join middle on hosts.domain = middle.domain, by_host),
judged as (select page_id, parts.host, path,
  case when (parts.host = 'example.net' or parts.host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (parts.host = 'example.com' or parts.host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (parts.host = 'org' or parts.host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (parts.host = 'net' or parts.host like '%.net') and path like '/%' then 'net/' end as rule,
  rate - 1.645 * sqrt(rate * (1 - rate) / (n + m + 1)) as lower_bound
  from parts join rated on parts.host = rated.host)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when lower_bound > 0.5 then 'block' else 'allow' end as verdict
from judged"""
