"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1: bad) are counted by host, registered domain and suffix. At each level a beta-binomial prior's
strength comes from the spread between the groups (analysis of variance), its mean from the level above, so a host with
few outcomes leans on its domain, that on its suffix, that on the whole. A host without outcomes has the prior of its domain,
or of the first level above it that has outcomes. A host is blocked where its bad rate is over BAD_RATE with posterior
probability SURE at least, by the beta distribution itself.

A registered domain is a public suffix and one label more; suffixes of several labels are a parameter (SUFFIXES), all others
are the last label. An address of numbers is its own domain, in a suffix of its own.

Counts are sums with partial aggregation, so a hot host costs no more than another; priors are three numbers; the hosts to
block join as a broadcast of measured size, or else by a join whose hot partitions adaptive execution splits.

Null urls and urls without :// have an empty host and path and are allowed, unless a rule fits. Outcomes without a host or
a label don't count; repeated rows count each. Without outcomes every host is allowed. Urls of any length are read
whole. Only page_id and url are read of the pages, url and bad of the outcomes, so others may have any names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import BROADCAST_BYTES, keeping, small, stage, table

#: (verdict, host and path); at most a few hundred, as they become one CASE expression.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A host is blocked if its bad rate is over the first with the second as probability at least.
BAD_RATE, SURE = 0.25, 0.95
#: Public suffixes of two labels.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr", "com.tw", "github.io", "blogspot.com")
#: Words of a url that weakly label a page as bad where no outcomes are known.
WEAK = ("adult", "ads", "bet", "bets", "betting", "casino", "escort", "gambling", "lottery", "payday", "phishing", "pills", "poker", "porn", "slots", "spam", "viagra", "warez", "xxx")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule(host: Column, path: Column, rules: tuple, pick: int) -> Column:
    """The longest fitting rule's verdict (0) or text (1), else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule[1].partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule[pick])).otherwise(out)
    return out


def _named(hosts: DataFrame, suffixes: tuple) -> DataFrame:
    """hosts with domain and suffix."""
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    last = lambda n: F.regexp_extract("name", f"([^.]+[.]){{{n - 1}}}[^.]*$", 0)
    number = F.col("name").rlike("^[0-9]+([.][0-9]+){3}$") | F.col("name").startswith("[")
    suffix = F.when(number, "").when(last(2).isin(*suffixes), last(2)).otherwise(F.regexp_extract("name", "[^.]*$", 0))
    domain = F.when(number, F.col("name")).when(last(2).isin(*suffixes), last(3)).otherwise(last(2))
    named = hosts.withColumn("name", name).withColumn("suffix", suffix).withColumn("domain", domain)
    return named.withColumn("domain", F.when(F.col("domain") == "", F.col("name")).otherwise(F.col("domain"))).drop("name")


def _strength(g: int, n: int, x: int, squares: float, ratios: float, mean: float) -> float:
    """Prior strength of a level of g groups: (1 - rho) / rho, rho the correlation within groups, in (0, 1). squares: sum of
    n squared; ratios: sum of x squared over n, for the spread of the groups' rates around the mean."""
    rho, within, room = 0.001, mean * (1 - mean), n - squares / n - (g - 1)
    if within > 0 and room > 0:
        spread = ratios - 2 * mean * x + mean * mean * n
        rho = min(0.999, max(0.001, (spread - within * (g - 1)) / (within * room)))
    return (1 - rho) / rho


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz)."""
    c, d = np.ones_like(a), 1 / (1 - (a + b) * x / (a + 1))
    out, m = d.copy(), 0
    while True:
        m += 1
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            c, d = 1 + t / c, 1 / (1 + t * d)
            step = c * d
            out *= step
        if not len(a) or np.abs(step - 1).max() < 1e-13 or m > 200_000:
            return out


_gamma = np.frompyfunc(math.lgamma, 1, 1)


def beta_below(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """Probability that a beta variable is below x (regularised incomplete beta function); a and b are over 0."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    front = np.exp((_gamma(a + b) - _gamma(a) - _gamma(b)).astype(float) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    out = np.empty_like(a)
    out[low] = front[low] * _fraction(a[low], b[low], np.full(low.sum(), x)) / a[low]
    high = ~low
    out[high] = 1 - front[high] * _fraction(b[high], a[high], np.full(high.sum(), 1 - x)) / b[high]
    return out


def reputations(hosts: DataFrame, bad_rate: float = BAD_RATE) -> DataFrame | None:
    """host, good (the posterior probability that its bad rate is at most bad_rate) of hosts (host, domain, suffix, n, x): n
    outcomes, x of them bad. None without outcomes. The driver gets five sums for each of the three levels."""
    sums = (F.sum("n").alias("n"), F.sum("x").alias("x"))
    domains = hosts.groupBy("domain").agg(F.max("suffix").alias("suffix"), *sums)
    tops = domains.groupBy("suffix").agg(*sums)
    rows = [frame.where("n > 0").select(F.lit(i).alias("level"), "n", "x") for i, frame in enumerate((tops, domains, hosts))]
    n, x = F.col("n").cast("double"), F.col("x").cast("double")
    levels = rows[0].unionAll(rows[1]).unionAll(rows[2]).groupBy("level").agg(F.count("*"), F.sum("n"), F.sum("x"), F.sum(n * n), F.sum(x * x / n)).collect()
    if not levels:
        return None
    mean = levels[0][3] / levels[0][2]
    k = {level: _strength(*found, mean) for level, *found in levels}
    shrunk = lambda prior, level: F.when(F.col("n") > 0, (F.col("x") + k[level] * prior) / (F.col("n") + k[level])).otherwise(prior)
    rates = domains.join(tops.select("suffix", shrunk(F.lit(mean), 0).alias("s")), "suffix").select("domain", shrunk(F.col("s"), 1).alias("m"))
    rated = hosts.join(rates, "domain").select("host", (F.col("x") + k[2] * F.col("m")).alias("a"), (F.col("n") - F.col("x") + k[2] * (1 - F.col("m"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            good = np.where(a <= 0, 1.0, 0.0)
            both = (a > 0) & (b > 0)
            good[both] = beta_below(a[both], b[both], bad_rate)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(good)], names=["host", "good"])

    return rated.mapInArrow(run, "host string, good double")


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, bad_rate: float = BAD_RATE, sure: float = SURE, suffixes: tuple = SUFFIXES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url); outcomes has url and bad (0 or 1)."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("bad is not null").select(host_of(F.col("url")).alias("host"), F.lit(1).cast("long").alias("n"), F.col("bad").cast("long").alias("x"))
    every = known.unionAll(parts.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("x")))
    with keeping(pages.sparkSession) as kept:
        hosts = stage(_named(every.where("host <> ''").groupBy("host").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), suffixes))
        judged = reputations(hosts, bad_rate)
        method = F.lit("allow")
        if judged is not None:
            blocked = stage(judged.where(F.col("good") <= 1 - sure).select(F.col("host"), F.lit(True).alias("_blocked")), True)
            kept.append(blocked)
            parts = parts.join(small(blocked, broadcast_bytes), "host", "left")
            method = F.when(F.col("_blocked"), "block").otherwise("allow")
    rule = lambda pick: _rule(F.col("host"), F.col("path"), rules, pick)
    return parts.select("page_id", "host", "path", rule(1).alias("rule"), F.coalesce(rule(0), method).alias("verdict"))


def weak_outcomes(pages: DataFrame, words: tuple = WEAK) -> DataFrame:
    """url and bad of each page: 1 where a word of the url (letters between other characters, in any case) is in the list."""
    return pages.select("url", F.lower("url").rlike(f"(^|[^a-z])({'|'.join(words)})([^a-z]|$)").cast("int").alias("bad"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages; the tables hold no page outcomes, so weak ones are made."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, weak_outcomes(pages))


#: Written apart from the plan above: the same definition by recursive sums.
ORACLE = r"""with recursive parts as (
  select page_id, url, case when contains(url, '://') then translate(split_part(split_part(split_part(substr(url, strpos(url, '://') + 3), '/', 1), '?', 1), '#', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then split_part(split_part(substr(url, strpos(url, '://') + 3), '?', 1), '#', 1) else '' end as rest from pages),
cut as (select page_id, host, substr(rest, length(host) + 1) as path,
    cast(regexp_matches(lower(url), '(^|[^a-z])(adult|ads|bet|bets|betting|casino|escort|gambling|lottery|payday|phishing|pills|poker|porn|slots|spam|viagra|warez|xxx)([^a-z]|$)') as integer) as bad from parts),
counts as (select host, count(bad) as n, coalesce(sum(bad), 0) as x from cut where host <> '' group by host),
names as (select *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') as l from counts),
hosts as (select host, n, x, l[-1] as suffix, coalesce(l[-2] || '.', '') || l[-1] as domain from names),
domains as (select domain, max(suffix) as suffix, sum(n) as n, sum(x) as x from hosts group by domain),
tops as (select suffix, sum(n) as n, sum(x) as x from domains group by suffix),
whole as (select sum(n)::double as t, sum(x)::double / sum(n) as mu from tops),
groups as (select 1 as lv, n, x from tops union all select 2, n, x from domains union all select 3, n, x from hosts),
spread as (select lv, count(*) as g, sum(n::double * n) as sq, sum(n * (x::double / n - mu) * (x::double / n - mu)) as ss, any_value(t) as t, any_value(mu) as mu from groups, whole where n > 0 group by lv),
rho as (select lv, case when mu > 0 and mu < 1 and t - sq / t - (g - 1) > 0 then least(0.999, greatest(0.001, (ss - mu * (1 - mu) * (g - 1)) / (mu * (1 - mu) * (t - sq / t - (g - 1))))) else 0.001 end as rho from spread),
k as (select max((1 - rho) / rho) filter (lv = 1) as k1, max((1 - rho) / rho) filter (lv = 2) as k2, max((1 - rho) / rho) filter (lv = 3) as k3 from rho),
ts as (select suffix, (x + k1 * mu) / (n + k1) as s from tops, k, whole),
ds as (select domain, (x + k2 * s) / (n + k2) as m from domains join ts using (suffix), k),
ab as (select host, x + k3 * m as a, n - x + k3 * (1 - m) as b from hosts join ds using (domain), k),
io as (select host, a, b, 0.25 >= (a + 1) / (a + b + 2) as turned from ab where a > 0 and b > 0),
pq as (select host, turned, case when turned then b else a end as p, case when turned then a else b end as q, case when turned then 0.75 else 0.25 end as z from io),
cf as (
  select host, turned, p, q, z, 0 as i, 1.0::double as c, 1 / (1 - (p + q) * z / (p + 1)) as d, 1 / (1 - (p + q) * z / (p + 1)) as h from pq
  union all
  select host, turned, p, q, z, i + 1, 1 + v / c, 1 / (1 + v * d), h * (1 + v / c) / (1 + v * d) from (
    select *, case when i % 2 = 0 then (i // 2 + 1) * (q - (i // 2 + 1)) * z / ((p + 2 * (i // 2 + 1) - 1) * (p + 2 * (i // 2 + 1)))
      else -(p + (i // 2 + 1)) * (p + q + (i // 2 + 1)) * z / ((p + 2 * (i // 2 + 1)) * (p + 2 * (i // 2 + 1) + 1)) end as v from cf where i < 400)),
below as (select host, case when turned then 1 - y else y end as good from (
  select host, turned, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(z) + q * ln(1 - z)) * h / p as y from cf where i = 400)),
blocked as (select host from below where good <= 1 - 0.95::double union all select host from ab where b <= 0 and a > 0),
ruled as (select page_id, host, path, case
  when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
  when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from cut)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
  when host in (select host from blocked) then 'block' else 'allow' end as verdict from ruled"""
